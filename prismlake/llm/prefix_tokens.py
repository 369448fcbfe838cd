"""Exact token counts of every prefix of a text, by dynamic programming.

The tokens of a byte-pair encoding are its encoding exactly if each neighbouring
pair is: if no merge reaches over the border before both tokens are complete.
So a prefix has one last token, the one that may stand after the last token of
the rest, and the count at a place is one more than at that token's start. One
forward pass gives the counts of all prefixes of a word; a text's are the sums.

The counts are stored as their steps, a byte for each code point, and answer
what a text, any beginning of it, or a budget of tokens comes to, without
encoding anything again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .bpe_lexicon import Merges, byte_characters
from .common import Scratch, exact_id, in_worker, prepare, text_of, worker_caches

LIMIT = 1024
#: Pairs of tokens whose border has been looked at, and that a worker keeps.
_KEPT_PAIRS = 1_000_000
#: Words of more bytes are counted one by one, others together, so many at once.
_LONG, _TOGETHER = 64, 20_000
#: Pieces that a worker keeps.
_KEPT_PIECES = 600_000
#: Stands for a step that a signed byte can't hold; such a text is stored in 32 bits.
_WIDE = -128
_NEVER = 1 << 40
#: What the pattern takes for white space, and its words of which a part is cut in two.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT_IN_TWO = ("'re", "'ve", "'ll")
_RUNS = re.compile(f"[{_SPACE}]{{2,}}")
STORED = "id string, n_bytes long, steps binary"


class Borders:
    """Which tokens may stand side by side in an encoding."""

    def __init__(self, merges: Merges):
        width, self.width, self.rank_of = merges.width, merges.width, merges.rank_of
        parts: dict[int, tuple[int, int, int]] = {}
        for key, rank in self.rank_of.items():
            made = int(merges.made_of_rank[rank])
            parts.setdefault(made, (rank, key // width, key % width))
        for rank, a, b in parts.values():
            if max(parts.get(a, (-1,))[0], parts.get(b, (-1,))[0]) >= rank:
                raise ValueError("a merge comes before its parts are made; prefixes of such a vocabulary can't be counted this way")
        self.parts = parts
        self.after: dict[int, list[tuple[int, int]]] = {}
        self.before: dict[int, list[tuple[int, int]]] = {}
        self.known: dict[int, bool] = {}
        self.keys, self.said = np.array([-1], np.int64), np.array([False])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at a side of a token while it is made, each with the rank of the merge that ends it."""
        out, ends = [], _NEVER
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out
            ends, token = self.parts[token][0], self.parts[token][side]

    def may_meet(self, a: int, b: int) -> bool:
        """Whether no part of a merges with a part of b; of equal ranks, the merge further left comes first."""
        key = a * self.width + b
        known = self.known.get(key)
        if known is None:
            if a not in self.after:
                self.after[a] = self._edge(a, 2)
            if b not in self.before:
                self.before[b] = self._edge(b, 1)
            rank, width = self.rank_of.get, self.width
            known = not any((m := rank(x * width + y)) is not None and m < x_ends and m <= y_ends for x, x_ends in self.after[a] for y, y_ends in self.before[b])
            if len(self.known) >= _KEPT_PAIRS:
                self.known.clear()
            self.known[key] = known
        return known

    def meet(self, keys: np.ndarray) -> np.ndarray:
        """may_meet for many pairs, each as a * width + b."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = np.unique(keys[self.keys[at] != keys])
        if len(new):
            said = np.fromiter((self.may_meet(k // self.width, k % self.width) for k in new.tolist()), bool, len(new))
            if len(self.keys) + len(new) > _KEPT_PAIRS:
                self.keys, self.said = self.keys[:1], self.said[:1]
                return self.meet(keys)
            places = np.searchsorted(self.keys, new)
            self.keys, self.said = np.insert(self.keys, places, new), np.insert(self.said, places, said)
            at = np.searchsorted(self.keys, keys)
        return self.said[at]


class Beginnings:
    """The tokens' bytes as a tree of sorted arcs, walked for many words at once."""

    def __init__(self, own: dict[bytes, int]):
        number = {b"": 0}
        for b in own:
            for k in range(1, len(b) + 1):
                number.setdefault(b[:k], len(number))
        self.token = np.full(len(number), -1, np.int64)
        for b, t in own.items():
            self.token[number[b]] = t
        arcs = sorted((number[b[:-1]] * 256 + b[-1], n) for b, n in number.items() if b)
        self.keys, self.targets = np.array([a for a, _ in arcs], np.int64), np.array([n for _, n in arcs], np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which go on, and where those come to."""
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return hit, self.targets[at[hit]]


class PrefixCounter(tokens.PieceEncoder):
    """Steps of prefix counts, from texts; pieces that occur again are kept, as tokens.PieceEncoder keeps ids."""

    def __init__(self, name_or_path: str = tokens.DEFAULT_VOCABULARY, kept: int = _KEPT_PIECES):
        super().__init__(name_or_path, kept)
        import public_tokenizers
        import regex

        merges = Merges(name_or_path)
        self.borders = Borders(merges)
        special = set(self.special)
        own = [(i, b) for i, b in merges.bytes_of.items() if b and self.library.id_to_token(i) not in special]
        coded = merges.many([b for _, b in own])
        #: Tokens that are their own encoding, by their bytes.
        self.tokens = {b: i for (i, b), ids in zip(own, coded, strict=True) if len(ids) == 4}
        self.beginnings = Beginnings(self.tokens)
        self.longest = max(map(len, self.tokens))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.between = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.fixed = {"": b"\x01", tokens.LINE_START: b"\x01", tokens.TEXT_START: b""}
        self.known = dict(self.fixed)

    def steps_of_words(self, words: list[str]) -> list[np.ndarray]:
        """For each word that the pattern keeps whole, the steps of its prefix counts, by code points."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        raw = [w.encode() for w in words]
        together = []
        for k, (word, b) in enumerate(zip(words, raw, strict=True)):
            if word in _CUT_IN_TWO:
                out[k] = np.array([1, 1, self._one(b)[-1] - 2])
            elif len(b) > _LONG:
                counts = self._one(b)
                ends = [i for i in range(1, len(b)) if b[i] & 0xC0 != 0x80]
                out[k] = np.diff(np.array(counts, np.int64)[[0, *ends, len(b)]])
            elif b:
                together.append(k)
        for first in range(0, len(together), _TOGETHER):
            lot = together[first : first + _TOGETHER]
            for k, steps in zip(lot, self._many([raw[k] for k in lot]), strict=True):
                out[k] = steps
        return out

    def _one(self, raw: bytes) -> list[int]:
        """The count of tokens of each prefix by bytes, the empty one first; for long words."""
        n, get, may_meet = len(raw), self.tokens.get, self.borders.may_meet
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before, count = last[i], counts[i] + 1
            for j in range(i + 1, min(n, i + self.longest) + 1):
                t = get(raw[i:j])
                if t is not None and last[j] < 0 and (before < 0 or may_meet(before, t)):
                    last[j], counts[j] = t, count
        return counts

    def _many(self, raw: list[bytes]) -> list[np.ndarray]:
        """Steps as in steps_of_words: all words go on together, from each place to the ends of the tokens that start there."""
        sizes = np.array([len(b) for b in raw])
        most, width = int(sizes.max()), self.borders.width
        text = np.zeros((len(raw), most), np.int64)
        inside = np.arange(most) < sizes[:, None]
        text[inside] = np.frombuffer(b"".join(raw), np.uint8)
        last, counts = np.full((len(raw), most + 1), -1, np.int64), np.zeros((len(raw), most + 1), np.int32)
        for i in range(most):
            rows = np.flatnonzero(sizes > i)
            state, j = np.zeros(len(rows), np.int64), i
            while len(rows):
                go, state = self.beginnings.step(state, text[rows, j])
                rows, j = rows[go], j + 1
                t = self.beginnings.token[state]
                may = np.flatnonzero((t >= 0) & (last[rows, j] < 0))
                if len(may) and i:
                    may = may[self.borders.meet(last[rows[may], i] * width + t[may])]
                last[rows[may], j] = t[may]
                counts[rows[may], j] = counts[rows[may], i] + 1
                more = sizes[rows] > j
                rows, state = rows[more], state[more]
        # Counts where a code point ends, and their differences within each word.
        ends = inside.copy()
        ends[:, :-1] &= (text[:, 1:] & 0xC0) != 0x80
        ends[np.arange(len(raw)), sizes - 1] = True
        found, each = counts[:, 1:][ends].astype(np.int64), ends.sum(axis=1)
        firsts = np.concatenate(([0], np.cumsum(each)[:-1]))
        steps = np.diff(found, prepend=0)
        steps[firsts] = found[firsts]
        return np.split(steps, firsts[1:])

    def _ids_of_words(self, keys: list[str]) -> list[bytes]:
        words = [k[1:] if k[0] == tokens.TEXT_START else k if k[0] == tokens.LINE_START else " " + k for k in keys]
        parts = [self.pattern.findall(w) for w in words]
        own = list({p for x in parts for p in x})
        found = self.steps_of_words(own)
        narrow = np.concatenate([*found, np.zeros(1, np.int64)])
        flat = np.where(np.abs(narrow) > 127, _WIDE, narrow).astype(np.int8).tobytes()
        at = np.cumsum([0, *map(len, found)]).tolist()
        as_bytes = {p: flat[at[k] : at[k + 1]] for k, p in enumerate(own)}
        return [b"".join([as_bytes[p] for p in x]) for x in parts]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            steps = np.diff(self.counts_of_text(text), prepend=0)
            wide = len(steps) and max(-int(steps.min()), int(steps.max())) > 127
            out.append(bytes([_WIDE & 255]) if wide else steps.astype(np.int8).tobytes())
        return out

    def counts_of_text(self, text: str) -> np.ndarray:
        """The counts of all prefixes but the empty one of any text, special tokens within it included."""
        out, total, at = [], 0, 0
        for m in self.between.finditer(text) if self.between else ():
            # Until a special token is complete, its beginning is text as any other.
            counts = self._plain(text[at : m.end() - 1])
            inside = int(counts[m.start() - at - 1]) if m.start() > at else 0
            out += [counts + total, np.array([total + inside + 1])]
            total, at = total + inside + 1, m.end()
        out.append(self._plain(text[at:]) + total)
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        words = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if sum(map(len, words)) != len(text):
            raise ValueError("the vocabulary's words don't cover the text")
        runs = list(_RUNS.finditer(text))
        own = list({*words, *(m.group() for m in runs)})
        steps_of = dict(zip(own, self.steps_of_words(own), strict=True))
        totals = np.cumsum(np.concatenate([steps_of[w] for w in words]))
        counts = totals.copy()
        # A prefix that ends within white space has all of that run as one word.
        for m in runs:
            before = int(totals[m.start() - 1]) if m.start() else 0
            counts[m.start() : m.end()] = before + np.cumsum(steps_of[m.group()])
        return counts

    def stored(self, texts: list[str]) -> list[bytes]:
        """For each text a byte 1 or 4, the width, and the steps of its prefix counts in that many bytes each."""
        out = []
        for text, raw in zip(texts, self.encode(texts), strict=True):
            if _WIDE & 255 in raw:
                raw = b"\x04" + np.diff(self.counts_of_text(text), prepend=0).astype("<i4").tobytes()
            else:
                raw = b"\x01" + raw
            out.append(raw)
        return out


def prefix_counts_of(stored: bytes) -> np.ndarray:
    """The token counts of all prefixes, the empty one first, from what PrefixCounter.stored made."""
    steps = np.frombuffer(stored, "<i4" if stored[0] == 4 else np.int8, offset=1)
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


_loaded: dict[str, PrefixCounter] = {}
worker_caches.append(_loaded)


def counter(vocabulary: str) -> PrefixCounter:
    if vocabulary not in _loaded:
        _loaded.clear()
        _loaded[vocabulary] = PrefixCounter(vocabulary)
    return _loaded[vocabulary]


@in_worker("prefix_tokens")
def _store(vocabulary: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = counter(vocabulary)
    for frame in frames:
        texts, ids = frame["text"].tolist(), frame["id"].tolist()
        for lot in tokens.in_lots(texts):
            part = [texts[k] for k in lot]
            yield pd.DataFrame({"id": [ids[k] for k in lot], "n_bytes": [len(t.encode()) for t in part], "steps": own.stored(part)})


def store_prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each row of df: id (a string of decimals, or null), n_bytes, and steps, the prefix counts as stored.

    Every text is read whole; a null text counts as empty and has no steps but
    the width. Rows with a null id and repeated rows have rows of their own. An
    empty table gives no rows; other columns are not read.
    """
    prepare(df.sparkSession)
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(lambda frames: _store(vocabulary, frames), STORED)


@in_worker("prefix_tokens")
def _answers(limits: tuple[int, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        totals, fits = [], []
        for raw in frame["steps"]:
            counts = prefix_counts_of(raw)
            totals.append(int(counts[-1]))
            fits.append([len(counts) - 1 - int(np.argmax(counts[::-1] <= limit)) if counts[-1] > limit else len(counts) - 1 for limit in limits])
        yield pd.DataFrame({"id": frame["id"], "n_bytes": frame["n_bytes"], "n_tokens": totals, "fits": fits})


def answer_budgets(stored: DataFrame, limits: tuple[int, ...] = (LIMIT,)) -> DataFrame:
    """For each stored row its id, n_bytes, n_tokens, and fits: for each limit, a budget of 0 or more tokens, the most code points
    from the text's start that come to no more tokens. A longer prefix may have fewer tokens than a shorter one; the longest counts."""
    if min(limits, default=0) < 0:
        raise ValueError("a budget of tokens can't be negative")
    return stored.mapInPandas(lambda frames: _answers(tuple(limits), frames), "id string, n_bytes long, n_tokens long, fits array<long>")


@in_worker("prefix_tokens")
def _at(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for raw, cuts in zip(frame["steps"], frame["cuts"], strict=True):
            counts = prefix_counts_of(raw)
            found.append([int(counts[min(int(c), len(counts) - 1)]) for c in cuts])
        yield pd.DataFrame({"id": frame["id"], "cuts": frame["cuts"], "n_tokens": found})


def tokens_at(stored: DataFrame, cuts) -> DataFrame:
    """For each stored row its id, cuts (places in code points, a Column of arrays over the stored row or a list) and
    n_tokens, the counts of the prefixes that end there; a place beyond the end stands for the end."""
    if isinstance(cuts, (list, tuple)):
        cuts = F.array(*[F.lit(int(c)) for c in cuts])
    return stored.select("id", "steps", cuts.cast("array<long>").alias("cuts")).mapInPandas(_at, "id string, cuts array<long>, n_tokens array<long>")


def truncate(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """df with text_col cut to its longest beginning of at most limit tokens; texts, null ones too, that fit stay as they are.

    The cut is looked up beside the text, in the same pass, so repeated and null ids need no join.
    """
    if limit < 0:
        raise ValueError("a budget of tokens can't be negative")
    prepare(df.sparkSession)
    names, fields = df.columns, df.schema

    @in_worker("prefix_tokens")
    def cut(frames):
        own = counter(vocabulary)
        for table in frames:
            texts = table.column(names.index(text_col)).to_pylist()
            out: list[str | None] = []
            for text in texts:
                if text:
                    counts = prefix_counts_of(own.stored([text])[0])
                    if counts[-1] > limit:
                        text = text[: len(counts) - 1 - int(np.argmax(counts[::-1] <= limit))]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == names.index(text_col) else c for k, c in enumerate(table.columns)], names=names)

    return df.mapInArrow(cut, fields)


def count_tokens(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each row of df: id_col, n_bytes, n_tokens, over_limit, fit_chars.

    The prefix counts are written to the shared folder once, and the answers read
    from there. n_bytes is the length in UTF-8, n_tokens the count as the library
    gives it without added special tokens, over_limit whether that exceeds limit,
    fit_chars the most code points that fit into limit tokens. Null texts count as
    empty, with no tokens; rows with a null id and repeated rows are kept; an
    empty table gives no rows.
    """
    stored = Scratch(df.sparkSession, "prefix-tokens").save(store_prefix_counts(df, id_col, text_col, vocabulary), "stored", compression="zstd")
    said = answer_budgets(stored, (limit,))
    return said.select(F.col("id").cast("long").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("fits")[0].alias("fit_chars"))
