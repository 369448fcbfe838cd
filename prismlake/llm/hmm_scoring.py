"""Language-model scores by a hidden Markov model.

Baum-Welch runs over all training documents: each partition adds up its expected
counts, Spark sums them by word, and the driver gets one row for each word of a
bounded vocabulary. The most frequent words have emissions of their own in each
state from the first round on; the rest are a class until the last round, which
also adds up each rare word's expected counts by state. These stay a table with
a row for each rare word of the corpus, and a shuffle joins them to the texts,
so all words have emissions of their own, however many there are. The model
gives every text a probability, and no table of all words is broadcast.

Texts are split and looked up once: their tokens' numbers are written to the
shared folder, and the rounds and the scoring read those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, exact_id, in_worker, most_frequent, text_of

STATES, ROUNDS = 4, 3
#: Words with emissions of their own, and documents that the first guess of the states is made from.
HEAD_WORDS, SEED_DOCUMENTS = 32_768, 1500
#: Steps of a recursion that run one after another; longer texts are cut there and joined exactly.
SEGMENT = 512
LOT_TOKENS = 600_000
#: Tokens that a task counts at once, and rows of its counts in a batch.
COUNTED_TOKENS, COUNTED_ROWS = 4_000_000, 200_000
#: What each count of starts and moves gets in addition; the counts of words get a prior of so many words that follow the corpus.
SMOOTHING, PRIOR = 0.01, 60.0
#: How often a rare word's expected counts by state weigh its count in the whole corpus: once for each state.
OWN_WEIGHT = float(STATES)
#: Rare words' expected counts in a document are kept in steps of 1 / FINE, so their sums are exact in any order and take little room.
FINE = 32
#: Rare words' shares are rounded down to steps of 1 / OCTAVE of a factor 2 and kept in 16 bits, four to a long: 64 factors of 2 are beyond any corpus.
OCTAVE = 1024
#: Stands for the end of a text in the table of counts; no word holds white space.
END = "\n"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


class Model:
    """start[k], move[k, l], emit[word or class, k]; the class of all other words is the last row."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


class Segments:
    """The tokens of some texts, cut into segments of at most SEGMENT tokens, longest first."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        self.tokens = np.concatenate(texts).astype(np.int64)
        ends = np.cumsum(sizes)
        rows = []
        for d, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            rows += [(min(SEGMENT, n - a), end - n + a, d, a // SEGMENT) for a in range(0, n, SEGMENT)]
        self.length, self.at, self.text, self.nth = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        self.n_texts = len(texts)

    def order(self, chosen: np.ndarray) -> np.ndarray:
        return chosen[np.argsort(-self.length[chosen], kind="stable")]


class Steps:
    """Segments sorted by falling length, their tokens step after step: what a step reads lies side by side, a row for each state."""

    def __init__(self, model: Model, seg: Segments, rows: np.ndarray):
        self.rows, self.length = rows, seg.length[rows]
        #: How many segments have each step, and where its tokens begin.
        self.alive = np.searchsorted(-self.length, -np.arange(self.length[0] if len(rows) else 0), side="left").tolist()
        self.start = np.cumsum([0, *self.alive])
        at = seg.at[rows]
        self.at = np.concatenate([at[:n] + t for t, n in enumerate(self.alive)] or [at])
        self.tokens = seg.tokens[self.at]
        self.emit = np.take(np.ascontiguousarray(model.emit.T), self.tokens, axis=1)

    def __iter__(self):
        """Each step, how many segments have it, and the place of its tokens."""
        for t, (n, start) in enumerate(zip(self.alive, self.start.tolist())):
            yield t, n, slice(start, start + n)


def _transfer(model: Model, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, the product of its step matrices, scaled, and the log of the scale."""
    k = len(model.start)
    move = np.ascontiguousarray(model.move.T)
    # Axes: the state before the segment, the state now, the segment.
    m, logs = np.repeat(np.eye(k)[:, :, None], len(steps.rows), axis=2), np.zeros(len(steps.rows))
    for _, n, here in steps:
        x = np.matmul(move, m[:, :, :n])
        x *= steps.emit[:, here]
        total = x.sum(axis=(0, 1))
        np.divide(x, total, out=m[:, :, :n])
        logs[:n] += np.log(total)
    return m.transpose(2, 0, 1), logs


def _chains(model: Model, seg: Segments, later: Steps, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the later segments of long texts: the forward vector before each, the backward vector after each segment, and the log likelihood that each later segment adds."""
    k = len(model.start)
    before, after, logs = np.zeros((len(seg.length), k)), np.ones((len(seg.length), k)), np.zeros(len(seg.length))
    if len(later.rows):
        m, scale = _transfer(model, later)
        of = {(int(seg.text[r]), int(seg.nth[r])): i for i, r in enumerate(later.rows)}
        row = {(d, j): r for r, (d, j) in enumerate(zip(seg.text.tolist(), seg.nth.tolist(), strict=True))}
        now = ends[0]
        for (d, j), i in sorted(of.items()):
            now = ends[row[d, 0]] if j == 1 else now
            before[row[d, j]] = now
            now = now @ m[i]
            logs[row[d, j]] = math.log(now.sum()) + scale[i]
            now = now / now.sum()
        for (d, j), i in sorted(of.items(), reverse=True):
            x = m[i] @ after[row[d, j]]
            after[row[d, j - 1]] = x / x.sum() * k
    return before, after, logs


def _forward(model: Model, steps: Steps, before: np.ndarray | None):
    """The scaled forward recursion along segments; before is None for first segments. Logs and last vectors of segments, vectors and scales of tokens."""
    move = np.ascontiguousarray(model.move.T)
    x, scale = np.empty_like(steps.emit), np.empty(steps.emit.shape[1])
    last = None
    for t, n, here in steps:
        now, total = x[:, here], scale[here]
        if t:
            np.matmul(move, last[:, :n], out=now)
        else:
            now[:] = model.start[:, None] if before is None else move @ before[steps.rows].T
        now *= steps.emit[:, here]
        np.sum(now, axis=0, out=total)
        now /= total
        last = now
    step_logs, logs = np.log(scale), np.zeros(len(steps.rows))
    for _, n, here in steps:
        logs[:n] += step_logs[here]
    return logs, x[:, steps.start[steps.length - 1] + np.arange(len(steps.rows))], x, scale


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log of each text's probability, exactly, over whole texts."""
    seg = Segments(texts)
    first = Steps(model, seg, seg.order(np.flatnonzero(seg.nth == 0)))
    logs, last, _, _ = _forward(model, first, None)
    ends = np.zeros((len(seg.length), len(model.start)))
    ends[first.rows] = last.T
    out = np.zeros(seg.n_texts)
    out[seg.text[first.rows]] = logs
    _, _, added = _chains(model, seg, Steps(model, seg, seg.order(np.flatnonzero(seg.nth > 0))), ends)
    np.add.at(out, seg.text, added)
    return out


class Counts:
    """Expected counts of one partition."""

    def __init__(self, k: int, rows: int):
        self.start, self.move, self.emit, self.log = np.zeros(k), np.zeros((k, k)), np.zeros((rows, k)), 0.0

    def add(self, model: Model, texts: list[np.ndarray], keep: bool = False) -> np.ndarray | None:
        """Forward and backward over whole texts; segments take the exact vectors at their ends. If to be kept, the probabilities of each state, a row, at each token."""
        seg = Segments(texts)
        k = len(model.start)
        first, later = (Steps(model, seg, seg.order(np.flatnonzero(x))) for x in (seg.nth == 0, seg.nth > 0))
        logs, *passed = _forward(model, first, None)
        ends = np.zeros((len(seg.length), k))
        ends[first.rows] = passed[0].T
        before, after, added = _chains(model, seg, later, ends)
        self.log += float(logs.sum() + added.sum())
        posterior = np.empty((k, len(seg.tokens))) if keep else None
        moves = np.zeros((k, k))
        for steps, prior in ((first, None), (later, before)):
            if not len(steps.rows):
                continue
            last, x, scale = passed if prior is None else _forward(model, steps, prior)[1:]
            beta = np.ascontiguousarray(after[steps.rows].T)
            beta /= (last * beta).sum(axis=0)
            g = np.empty_like(x)
            # Forward vectors add up to one, so products with these backward vectors do at every step.
            for t, n, here in reversed(list(steps)):
                np.multiply(x[:, here], beta[:, :n], out=g[:, here])
                if t or prior is not None:
                    right = steps.emit[:, here] * beta[:, :n]
                    right /= scale[here]
                    left = x[:, steps.start[t - 1] : steps.start[t - 1] + n] if t else prior[steps.rows].T
                    moves += left @ right.T
                    np.matmul(model.move, right, out=beta[:, :n])
                else:
                    self.start += g[:, here].sum(axis=1)
            for j in range(k):
                self.emit[:, j] += np.bincount(steps.tokens, weights=g[j], minlength=len(self.emit))
            if keep:
                posterior[:, steps.at] = g
        self.move += moves * model.move
        return posterior


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return Model(norm(start + SMOOTHING, 0), norm(move + SMOOTHING, 1), norm(emit + PRIOR * unigram[:, None], 0))


class Vocabulary:
    """The frequent words, with their counts; everything else is the class after them."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int):
        self.index = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], dtype=np.float64)
        self.total, self.distinct, self.tail = total, distinct, len(head)
        self.tail_total, self.tail_distinct = total - int(self.counts.sum()), distinct - len(head)

    def unigram(self) -> np.ndarray:
        """The corpus's distribution over frequent words and the class of all others."""
        n = np.append(self.counts, self.tail_total) + SMOOTHING
        return n / n.sum()

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words and of the text's end, in 16 bits where they fit."""
        get, tail = self.index.get, self.tail
        ids = list(map(get, words, repeat(tail)))
        ids.append(get(END.encode(), tail))
        return np.array(ids, dtype=self.kind)

    @property
    def kind(self) -> str:
        return "<u2" if self.tail < 1 << 16 else "<u4"


def _lots(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.Table]:
    """The rows in lots of about LOT_TOKENS tokens, by their column ids."""
    lot, size = [], 0
    for batch in batches:
        upto = np.append(0, np.cumsum(pc.binary_length(batch.column("ids")).to_numpy() // np.dtype(kind).itemsize))
        start = 0
        while start < batch.num_rows:
            # With the row that fills the lot.
            stop = min(int(np.searchsorted(upto, upto[start] + LOT_TOKENS - size)), batch.num_rows)
            lot.append(batch.slice(start, stop - start))
            size += int(upto[stop] - upto[start])
            start = stop
            if size >= LOT_TOKENS:
                yield pa.Table.from_batches(lot)
                lot, size = [], 0
    if lot:
        yield pa.Table.from_batches(lot)


def _arrays(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(raw, kind) for raw in column.to_pylist()]


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What words_of gives for each text, one after another, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end splits off an empty string
    upto = np.append(0, np.cumsum(some))
    return words.filter(pa.array(some)), np.diff(upto[ends], prepend=0)


@in_worker("hmm")
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, those of some millions of tokens at a time, and of the texts' ends."""

    def counted():
        found = pa.chunked_array(seen, pa.string()).value_counts()
        for start in range(0, len(found), COUNTED_ROWS):
            part = found.slice(start, COUNTED_ROWS)
            yield pa.RecordBatch.from_arrays([part.field("values"), part.field("counts")], names=["word", "n"])

    seen, size, ends = [], 0, 0
    for batch in batches:
        words, _ = split_texts(batch.column("text"))
        seen.append(words)
        size, ends = size + len(words), ends + batch.num_rows
        if size >= COUNTED_TOKENS:
            yield from counted()
            seen, size = [], 0
    yield from counted()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "n"])


def is_held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 7 == 2, F.lit(False))


def _first_guess(train: DataFrame, vocabulary: Vocabulary, states: int, seeds: int) -> Model:
    """Group a bounded sample of documents by their frequent words; each group starts a state. Only where the rounds begin depends on the sample."""
    wide = min(256, vocabulary.tail)

    def bags(frames):
        for frame in frames:
            ids = [vocabulary.encode(words_of(t)) for t in frame["text"]]
            counted = [np.unique(x, return_counts=True) for x in ids]
            yield pd.DataFrame({"key": frame["id"], "ids": [a for a, _ in counted], "n": [b for _, b in counted]})

    chosen = bounded_sample(train, seeds, "id")
    got = chosen.mapInPandas(bags, "key long, ids array<long>, n array<long>").toPandas()
    got = got.assign(ids=got["ids"].map(np.asarray), n=got["n"].map(np.asarray))
    unigram = vocabulary.unigram()
    emit = np.tile(unigram[:, None], (1, states))
    if len(got) >= states and wide:
        x = np.zeros((len(got), wide))
        for i, (a, b) in enumerate(zip(got["ids"], got["n"], strict=True)):
            near = a < wide
            x[i, a[near]] = np.sqrt(b[near])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(11)
        centre = x[[int(rng.integers(len(x)))]]
        while len(centre) < states:  # each next centre is far from those before
            far = np.maximum(0, 1 - (x @ centre.T).max(axis=1)) ** 2 + 1e-12
            centre = np.vstack((centre, x[rng.choice(len(x), p=far / far.sum())]))
        for _ in range(15):
            own = (x @ centre.T).argmax(axis=1)
            centre = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centre[k] for k in range(states)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        for k in range(states):
            mine = np.zeros(len(unigram))
            for a, b, o in zip(got["ids"], got["n"], own, strict=True):
                if o == k:
                    mine[a] += b
            if mine.sum():
                emit[:, k] = 0.4 * unigram + 0.6 * mine / mine.sum()
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit)


def _binaries(values: np.ndarray, items: np.ndarray) -> pa.Array:
    """Values as binaries of so many items each."""
    ends = np.append(0, np.cumsum(items)) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(items), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(np.ascontiguousarray(values))])


def encode_documents(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows (id, text, held_out) with the tokens' numbers in place of texts, what frequent words add to the base, and the others with their order.

    row tells rows apart, and leaves a number free after it for each rare word of
    the text; id stays as it comes, so it is best a string where it may be null.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @in_worker("hmm")
    def encode(batches):
        from pyspark import TaskContext

        row, v = TaskContext.get().partitionId() << 40, shared.value
        frequent, end = pa.array([w.decode() for w in v.index], pa.string()), v.index.get(END.encode(), v.tail)
        base = np.append(np.log10((v.counts + 1) / (v.total + v.distinct + 1)), 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, n_words = split_texts(batch.column("text"))
            own = pc.index_in(words, value_set=frequent).fill_null(v.tail).to_numpy()
            rare = own == v.tail
            coded = words.filter(pa.array(rare)).dictionary_encode()
            code = np.zeros(len(own), dtype=np.int64)
            code[rare] = coded.indices.to_numpy()
            # Each text's end comes after its words; where it isn't frequent, it is one more rare word.
            ends, spelled = np.cumsum(n_words), pa.concat_arrays([coded.dictionary, pa.array([END])])
            own, code = np.insert(own, ends, end), np.insert(code, ends, len(spelled) - 1)
            text, rare = np.repeat(np.arange(len(ends)), n_words + 1), own == v.tail
            text, code = text[rare], code[rare]
            # A text's rare words are numbered in order of their first places.
            pairs = pa.array(text * len(spelled) + code).dictionary_encode()
            of, word = np.divmod(pairs.dictionary.to_numpy(), len(spelled))
            n_rare = np.bincount(of, minlength=len(ends))
            upto = np.append(0, np.cumsum(n_rare))
            at = pairs.indices.to_numpy() - upto[text]
            out = {
                "row": pa.array(row + upto[:-1] + np.arange(len(ends))), "id": batch.column("id"), "held_out": batch.column("held_out"), "ids": _binaries(own.astype(v.kind), n_words + 1),
                "head_base": pa.array(np.add.reduceat(base[own], np.append(0, np.cumsum(n_words + 1)[:-1]))),
                "rare": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spelled.take(pa.array(word))), "rare_at": _binaries(at.astype("<u4"), np.bincount(text, minlength=len(ends))),
            }
            row += int(upto[-1]) + len(ends)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    id_type = dict(rows.dtypes)["id"]
    return rows.select("id", "text", "held_out").mapInArrow(encode, f"row long, id {id_type}, held_out boolean, ids binary, head_base double, rare array<string>, rare_at binary")


def _sums(own: Counts, states: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A partition's expected counts as rows, and their values for each state; rows below 0 are the log likelihood, the start, the moves."""
    at = np.flatnonzero(own.emit.any(axis=1))
    rest = np.vstack((np.append(own.log, np.zeros(states - 1)), own.start, own.move))
    return np.append(at, -1 - np.arange(len(rest))), list(np.vstack((own.emit[at], rest)).T)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _maximise(sums: pd.DataFrame, vocabulary: Vocabulary, states: int) -> tuple[Model, float]:
    """The next model, and the log likelihood of the last one."""
    size = vocabulary.tail + 1
    total = np.zeros((size + 2 + states, states))
    total[np.where(sums["row"] >= 0, sums["row"], size - 1 - sums["row"])] = sums[[f"v{k}" for k in range(states)]].to_numpy()
    return estimate(total[size + 1], total[size + 2 :], total[:size], vocabulary.unigram()), float(total[size, 0])


def train_model(train: DataFrame, vocabulary: Vocabulary, first: Model, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over train (ids, as encode_documents writes them); the model, and the log likelihood before each round."""
    spark: SparkSession = train.sparkSession
    model, history = first, []
    states, size, kind = len(first.start), vocabulary.tail + 1, vocabulary.kind
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        @in_worker("hmm")
        def expect(batches, now=now):
            own = Counts(states, size)
            for lot in _lots(batches, kind):
                own.add(now.value, _arrays(lot["ids"], kind))
            row, values = _sums(own, states)
            yield _batch({"row": row, **{f"v{k}": x for k, x in enumerate(values)}})

        sums = train.select("ids").mapInArrow(expect, "row long, " + ", ".join(f"v{k} double" for k in range(states))).groupBy("row").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(states)]).toPandas()
        model, log = _maximise(sums, vocabulary, states)
        history.append(log)
        now.unpersist()
    return model, history


def last_round(train: DataFrame, vocabulary: Vocabulary, model: Model, scratch: Scratch) -> tuple[Model, DataFrame]:
    """One round that counts rare words too: the model, and a written table (word, v0, v1, ...) of all rare words; over all states v add up to the word's count."""
    states, size, kind = len(model.start), vocabulary.tail + 1, vocabulary.kind
    now = train.sparkSession.sparkContext.broadcast(model)

    @in_worker("hmm")
    def expect(batches):
        own = Counts(states, size)
        for lot in _lots(batches, kind):
            texts, at = _arrays(lot["ids"], kind), _arrays(lot["rare_at"], "<u4")
            posterior = own.add(now.value, texts, keep=True)[:, np.concatenate(texts) == size - 1]
            n_rare = pc.list_value_length(lot["rare"]).to_numpy()
            at = np.concatenate(at) + np.repeat(np.cumsum(n_rare) - n_rare, [len(x) for x in at])
            v = [np.rint(np.bincount(at, weights=x, minlength=n_rare.sum()) * FINE) / FINE for x in posterior[: states - 1]]
            v.append(np.bincount(at, minlength=n_rare.sum()) - sum(v))
            # Steps are those of each text; a word's sum over the lot is exact, and one row.
            coded = pa.concat_arrays([x.flatten() for x in lot["rare"].chunks]).dictionary_encode()
            words, of = coded.dictionary, coded.indices.to_numpy()
            if len(words):
                yield _batch({"row": np.full(len(words), size), "word": words, **{f"v{k}": np.bincount(of, weights=x, minlength=len(words)) for k, x in enumerate(v)}})
        row, values = _sums(own, states)
        yield _batch({"row": row, "word": pa.nulls(len(row), pa.string()), **{f"v{k}": x for k, x in enumerate(values)}})

    columns = [f"v{k}" for k in range(states)]
    schema = "row long, word string, " + ", ".join(f"{c} double" for c in columns)
    rows = train.select("ids", "rare", "rare_at").mapInArrow(expect, schema).groupBy("row", "word").agg(*[F.sum(c).alias(c) for c in columns])
    sums = scratch.save(rows, "expected", "zstd")
    model, _ = _maximise(sums.where(F.col("word").isNull()).drop("word").toPandas(), vocabulary, states)
    now.unpersist()
    return model, sums.where(F.col("word").isNotNull()).drop("row")


SCORED = pa.schema([("id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_lot(kind: str, denominator: int, model: Model, docs: list[dict], shares: np.ndarray) -> pa.RecordBatch:
    """Scores of some texts; shares has a row (c, steps of each state) for each rare word of each text, in order. denominator is the base's."""
    tail, states = len(model.emit) - 1, len(model.start)
    packed = np.ascontiguousarray(shares[:, 1:]).view("<u2")[:, :states]
    # Rare words get rows after the frequent ones, for this lot alone.
    emit = np.vstack((model.emit, model.emit[tail] * np.exp2(packed / -OCTAVE)))
    texts, start = [], 0
    for doc in docs:
        ids = np.frombuffer(doc["ids"], kind).astype(np.int64)
        ids[ids == tail] = np.frombuffer(doc["rare_at"], "<u4") + np.int64(tail + 1 + start)
        texts.append(ids)
        start += doc["n_rare"]
    flat = np.concatenate(texts)
    times = np.bincount(flat[flat > tail] - tail - 1, minlength=len(shares))
    of = np.repeat(np.arange(len(docs)), [doc["n_rare"] for doc in docs])
    known = np.bincount(of, weights=times * (shares[:, 0] > 0), minlength=len(docs)).astype(np.int64)
    base = np.bincount(of, weights=times * np.log10((shares[:, 0] + 1) / denominator), minlength=len(docs))
    sizes = np.array([len(ids) for ids in texts])
    rare = np.array([len(doc["rare_at"]) // 4 for doc in docs])
    logs = log_likelihood(Model(model.start, model.move, emit), texts) / math.log(10)
    columns = [[doc["id"] for doc in docs], [doc["held_out"] for doc in docs], sizes, sizes - rare + known, base + [doc["head_base"] for doc in docs], logs]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCORED, strict=True)], schema=SCORED)


@in_worker("hmm")
def _score(kind: str, denominator: int, model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by row and at: a text (at -1), then its rare words' shares. A lot ends with a text whose shares are all there."""
    docs, parts, size, needed, have = [], [], 0, 0, 0
    for batch in batches:
        is_text = batch.column("at").to_numpy() < 0
        shares = batch.select(["c", *[name for name in batch.schema.names if name.startswith("p")]]).filter(pa.array(~is_text))
        parts.append(np.stack([x.to_numpy() for x in shares.columns], axis=1).astype("<i8"))
        have += len(parts[-1])
        for doc in batch.select(["id", "held_out", "head_base", "ids", "rare_at", "n_rare"]).filter(pa.array(is_text)).to_pylist():
            docs.append(doc)
            size += len(doc["ids"])
            needed += doc["n_rare"]
        if size < LOT_TOKENS * np.dtype(kind).itemsize:
            continue
        open_text = docs[-1:] if have < needed else []
        ready = docs[: len(docs) - len(open_text)]
        if ready:
            shares, n = np.concatenate(parts), sum(doc["n_rare"] for doc in ready)
            yield _score_lot(kind, denominator, model.value, ready, shares[:n])
            docs, parts, have = open_text, [shares[n:]], len(shares) - n
            size, needed = sum(len(doc["ids"]) for doc in docs), sum(doc["n_rare"] for doc in docs)
    if docs:
        yield _score_lot(kind, denominator, model.value, docs, np.concatenate(parts))


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row for each row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows that aren't held out, in at least one round. score is
    log10 of the probability of the text's tokens with its end: a rare word's is
    that of its class in the hidden state times its share of the class there,
    (w * expected count in the state + count + 1) / (w * rare words' expected
    counts in the state + tokens + words + 1), which leaves one share for words
    never seen; w is OWN_WEIGHT, expected counts are in steps of 1 / FINE for
    each document, and shares are rounded down to steps of 1 / OCTAVE. A null text is empty
    and has the end alone. A null id is kept, and its row is trained on. Rows are
    scored one by one, repeated ones too. Without training rows all words are
    unseen. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hmm")
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("id", "text")
    counts = scratch.save(train.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Words that occur once stand for those that never did: they are left to the class of rare words.
    head = [(w, n) for w, n in most_frequent(counts, head_words) if n > 1]
    vocabulary = Vocabulary(head, total["n"], total["v"])
    scratch.drop("counts")
    encoded = scratch.save(encode_documents(rows, vocabulary), "encoded", "zstd")
    trained = encoded.where(~F.col("held_out"))
    model, _ = train_model(trained, vocabulary, _first_guess(train, vocabulary, states, SEED_DOCUMENTS), rounds - 1)
    model, expected = last_round(trained, vocabulary, model, scratch)
    done, kind = spark.sparkContext.broadcast(model), vocabulary.kind
    names = [f"p{j}" for j in range(0, states, 4)]
    v = [F.col(f"v{j}") for j in range(states)]
    own = [F.greatest(x, F.lit(0.0)) * OWN_WEIGHT for x in v]  # steps of 1 / FINE may leave the last a little below 0
    tail = expected.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in own]).first()
    rest = float(vocabulary.tail_total + vocabulary.tail_distinct + 1)

    def packed(own: list[Column], c: Column) -> list[Column]:
        steps = [F.ceil(F.log2(F.lit(tail[j] + rest) / (x + c + 1)) * OCTAVE).cast("long") for j, x in enumerate(own)]
        return [reduce(Column.bitwiseOR, [F.shiftleft(x, 16 * i) for i, x in enumerate(steps[j : j + 4])]) for j in range(0, states, 4)]

    # Shares are made once for each word, before they are joined to the texts that hold it.
    c = sum(v[1:], v[0])
    shares = expected.select("word", c.cast("long").alias("c"), *[x.alias(name) for x, name in zip(packed(own, c), names, strict=True)])
    unseen = packed([F.lit(0.0)] * states, F.lit(0.0))
    pairs = encoded.select("row", F.posexplode("rare").alias("at", "word")).join(shares, "word", "left").select(
        "row", "at", F.coalesce("c", F.lit(0)).alias("c"), *[F.coalesce(name, x).alias(name) for name, x in zip(names, unseen, strict=True)]
    )
    # A text and the shares of its rare words meet by one shuffle and one sort; the text comes first. Its columns are one, so that rows of shares stay small.
    texts = encoded.select("row", F.lit(-1).alias("at"), F.struct("id", "held_out", "head_base", "ids", "rare_at", F.size("rare").alias("n_rare")).alias("text"))
    # Rows leave room for their rare words, so one number has the order of both, which Spark sorts without comparing.
    together = texts.unionByName(pairs, allowMissingColumns=True).repartition("row").sortWithinPartitions(F.col("row") + F.col("at"))
    together = together.select("row", "at", "c", *names, "text.*")
    denominator = int(vocabulary.total + vocabulary.distinct + 1)
    scored = together.mapInArrow(lambda batches: _score(kind, denominator, done, batches), "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"), "base_score", "score"
    )
