import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from prismlake.llm import hmm_scoring as H
from prismlake.llm.common import Scratch, most_frequent


def some_model(k, v, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    return H.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))


def forward_backward(m, o):
    n, k = len(o), len(m.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * m.emit[o[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.move) * m.emit[o[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[o[t + 1]] * b[t + 1])
    total = a[-1].sum()
    pairs = sum((np.outer(a[t], m.emit[o[t + 1]] * b[t + 1]) * m.move / total for t in range(n - 1)), np.zeros((k, k)))
    return math.log(total), a * b / total, pairs


@pytest.mark.parametrize("segment", [1, 4, 5, 512])
@pytest.mark.parametrize("states", [1, 3])
def test_recursions_are_exact_over_segments(monkeypatch, segment, states):
    monkeypatch.setattr(H, "SEGMENT", segment)
    m = some_model(states, 7)
    texts = [np.random.default_rng(n).integers(0, 7, n) for n in (1, 5, 40, 7, 23, 1)]
    logs = H.log_likelihood(m, texts)
    c = H.Counts(states, 7)
    c.add(m, texts)
    emit, move, start = np.zeros((7, states)), np.zeros((states, states)), np.zeros(states)
    for o, log in zip(texts, logs, strict=True):
        total, g, pairs = forward_backward(m, o)
        assert log == pytest.approx(total)
        np.add.at(emit, o, g)
        move += pairs
        start += g[0]
    assert np.allclose(c.emit, emit) and np.allclose(c.move, move) and np.allclose(c.start, start) and c.log == pytest.approx(logs.sum())


def test_rounds_raise_the_likelihood(spark, sample):
    train = sample.select(H.F.col("doc_id").alias("id"), "text")
    counts = Counter(w for r in train.collect() for w in H.words_of(r["text"]))
    counts[H.END.encode()] = train.count()
    head = [(w.decode(), n) for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:400]]
    vocabulary = H.Vocabulary(head, sum(counts.values()), len(counts))
    encoded = H.encode_documents(train.withColumn("held_out", H.F.lit(False)), vocabulary)
    _, history = H.train_model(encoded, vocabulary, H._first_guess(train, vocabulary, H.STATES, H.SEED_DOCUMENTS), rounds=4)
    assert all(b > a for a, b in zip(history, history[1:]))


def base_score(texts, held):
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update([*H.words_of(t), "end"])
    n, v = sum(c.values()), len(c)
    return {i: (len(H.words_of(t)) + 1, sum(c[w] > 0 for w in [*H.words_of(t), "end"]), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*H.words_of(t), "end"])) for i, t in texts}, n


@pytest.mark.parametrize("head", [40, 100_000])
def test_scores_of_the_sample(sample, sample_texts, head):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    expected, total = base_score(list(sample_texts.items()), held)
    rows = H.score_documents(sample, head_words=head).collect()
    assert len(rows) == len(sample_texts)
    for r in rows:
        n, known, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_the_model_is_a_distribution_over_words(spark):
    """All texts of two words from a small vocabulary, and one unseen word, have a probability of at most one together."""
    rows = [(i, t) for i, t in enumerate(["a b", "a c", "b a", "c c a", "a", ""] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = ["a", "b", "c", "unseen"]
    probe = [(1000 + k, t) for k, t in enumerate(["", *words, *(f"{x} {y}" for x in words for y in words)])]
    held = [r for r in probe if True]
    ids = (i for i in range(1000, 100_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    held = [(next(ids), t) for _, t in probe]
    scored = H.score_documents(df.unionByName(spark.createDataFrame(held, "doc_id long, text string")), head_words=2)
    total = sum(10 ** r["score"] for r in scored.where("held_out").collect() if r["doc_id"] >= 1000)
    assert 0.3 < total <= 1 + 1e-9


def test_awkward_rows(spark, docs):
    rows = H.score_documents(docs).collect()
    assert len(rows) == 14 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert H.score_documents(docs.where("false")).count() == 0
    only = docs.where(H.is_held_out("doc_id"))
    assert {r["train_tokens"] for r in H.score_documents(only).collect()} <= {0}


def test_most_frequent_words(spark):
    rng = np.random.default_rng(0)
    rows = [(f"w{i}", int(n)) for i, n in enumerate(rng.zipf(1.5, 500).clip(1, 10**9))]
    counts = Scratch(spark, "t").save(spark.createDataFrame(rows, "word string, n long"), "c")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for limit in (1, 7, 100, 499, 500, 1000):
        assert most_frequent(counts, limit) == order[:limit]
    assert most_frequent(counts.where("false"), 5) == []


@pytest.mark.parametrize("rows_a_batch, lot", [(1, 1), (3, 12), (1000, 1)])
def test_shares_reach_their_texts_across_batches_and_lots(monkeypatch, rows_a_batch, lot):
    """Texts scored in lots of any size, from batches cut anywhere, get what each gets alone."""
    rng = np.random.default_rng(3)
    emit = rng.dirichlet(np.ones(5), size=2).T
    model = H.Model(np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit)
    rows, wanted = [], []
    for d in range(9):
        n_rare = [0, 3, 1, 0, 7][d % 5]
        ids = np.array([0, 1, 4, 2] * 2 + [4] * n_rare + [3]) if n_rare else np.array([0, 1, 3])
        at = np.arange((ids == 4).sum()) % n_rare if n_rare else np.array([], dtype=int)
        steps, c = rng.integers(0, 5000, (n_rare, 2)), rng.integers(0, 4, n_rare)
        rows.append({"row": d, "at": -1, "id": str(d), "held_out": d == 2, "head_base": -1.0 * d, "ids": ids.astype("<u2").tobytes(), "rare_at": at.astype("<u4").tobytes(), "n_rare": n_rare, "c": None, "p0": None})
        rows += [{"row": d, "at": i, "c": int(c[i]), "p0": int(steps[i, 0] | steps[i, 1] << 16)} for i in range(n_rare)]
        own = np.vstack((emit, emit[4] * np.exp2(-steps / H.OCTAVE)))
        ids[ids == 4] = at + 5
        score = H.log_likelihood(H.Model(model.start, model.move, own), [ids])[0] / math.log(10)
        base = -1.0 * d + sum(math.log10((c[a] + 1) / 100) for a in at)
        wanted.append((str(d), d == 2, len(ids), len(ids) - sum(int(c[a] == 0) for a in at), base, score))
    kinds = {"row": "int64", "at": "int32", "id": "string", "held_out": "bool", "head_base": "float64", "ids": "binary", "rare_at": "binary", "n_rare": "int32", "c": "int64", "p0": "int64"}
    schema = H.pa.schema([(k, H.pa.type_for_alias(v)) for k, v in kinds.items()])
    batches = [H.pa.RecordBatch.from_pylist(rows[i : i + rows_a_batch], schema=schema) for i in range(0, len(rows), rows_a_batch)]
    monkeypatch.setattr(H, "LOT_TOKENS", lot)
    got = [r for batch in H._score("<u2", 100, SimpleNamespace(value=model), iter(batches)) for r in batch.to_pylist()]
    assert [(r["id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in got] == [w[:4] for w in wanted]
    assert [(r["base_score"], r["score"]) for r in got] == [pytest.approx(w[4:], rel=1e-12) for w in wanted]


AWKWARD = ["", " ", "a", "  A b\ta ", "\x1cx\x85y\x0bZ\x0c\xa0w\r\n", "Ünï ÜNÏ 日本 日本 \x00 q", "a a b " * 50, "\n", "iİ K K"]


def test_words_of_a_batch_are_those_of_each_text():
    for texts in (AWKWARD, [], [""], ["", None, "b"]):
        column = H.pa.array(["x y", *texts], H.pa.string())[1:]
        words, sizes = H.split_texts(column)
        wanted = [H.words_of(t or "") for t in texts]
        assert [w.encode() for w in words.to_pylist()] == [w for ws in wanted for w in ws] and sizes.tolist() == [len(ws) for ws in wanted]


@pytest.mark.parametrize("tokens, rows", [(1, 1), (7, 3), (10**6, 10**6)])
def test_counts_of_words_in_parts(monkeypatch, tokens, rows):
    monkeypatch.setattr(H, "COUNTED_TOKENS", tokens)
    monkeypatch.setattr(H, "COUNTED_ROWS", rows)
    got = Counter()
    for start in (0, 4):
        for batch in H._count_words(H.pa.RecordBatch.from_pydict({"text": H.pa.array(x, H.pa.string())}) for x in (AWKWARD[start : start + 2], [], AWKWARD[start + 2 : start + 4])):
            for r in batch.to_pylist():
                got[r["word"].encode()] += r["n"]
    wanted = Counter(w for t in AWKWARD[:8] for w in H.words_of(t))
    assert got == wanted + Counter({b"\n": 8})
    assert list(H._count_words(iter([]))) == []


@pytest.mark.parametrize("head", [[], [("a", 9)], [("\n", 30), ("a", 9), ("b", 4)]])
def test_numbers_spell_the_texts_and_rows_leave_room(spark, head):
    """A row leaves a number free for each rare word of its text, so one sort key has the order of texts and of their words."""
    texts = dict(enumerate([*AWKWARD, None]))
    df = spark.createDataFrame(list(texts.items()), "id string, text string").withColumn("held_out", H.F.lit(False))
    v = H.Vocabulary(head, 100, 20)
    got = sorted(H.encode_documents(df, v).collect(), key=lambda r: r["row"])
    frequent = {i: w for w, i in v.index.items()}
    base = {w.encode(): math.log10((n + 1) / 121) for w, n in head}
    for r in got:
        rare = iter(np.frombuffer(r["rare_at"], "<u4").tolist())
        words = [frequent[i] if i < v.tail else r["rare"][next(rare)].encode() for i in np.frombuffer(r["ids"], v.kind).tolist()]
        assert words == [*H.words_of(texts[int(r["id"])] or ""), b"\n"] and next(rare, None) is None
        assert len(set(r["rare"])) == len(r["rare"]) and r["head_base"] == pytest.approx(sum(base.get(w, 0.0) for w in words))
    assert len(got) == len(texts)
    assert all(b["row"] - a["row"] > len(a["rare"]) for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("tokens", [1, 5, 100])
def test_lots_hold_all_rows_in_order(monkeypatch, tokens):
    monkeypatch.setattr(H, "LOT_TOKENS", tokens)
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (1, 9, 2, 2, 1, 30, 1)]
    lots = list(H._lots((H.pa.RecordBatch.from_pydict({"ids": H.pa.array(x, H.pa.binary())}) for x in (ids[:3], [], ids[3:])), "<u2"))
    assert [x for lot in lots for x in lot["ids"].to_pylist()] == ids
    sizes = [sum(map(len, lot["ids"].to_pylist())) // 2 for lot in lots]
    assert all(n >= tokens for n in sizes[:-1]) and all(n - len(lot["ids"][-1].as_py()) // 2 < tokens for n, lot in zip(sizes, lots))


def test_a_lot_gives_a_rare_word_one_row(spark, sample, monkeypatch):
    """Expected counts are added up over a lot before they leave the task, in steps of each text."""
    train = sample.select(H.F.col("doc_id").cast("string").alias("id"), "text").withColumn("held_out", H.F.lit(False)).coalesce(1)
    counts = Counter(w for r in train.collect() for w in H.words_of(r["text"]))
    head = [(w.decode(), n) for w, n in counts.most_common(50)]
    vocabulary = H.Vocabulary(head, sum(counts.values()) + train.count(), len(counts) + 1)
    scratch = Scratch(spark, "t")
    encoded = scratch.save(H.encode_documents(train, vocabulary), "encoded")
    model = some_model(3, 51)
    found = {}
    for lot in (1, 10**9):
        monkeypatch.setattr(H, "LOT_TOKENS", lot)
        _, expected = H.last_round(encoded, vocabulary, model, scratch)
        found[lot] = {r["word"]: (r["v0"], r["v1"], r["v2"]) for r in expected.collect()}
    assert found[1] == found[10**9]
    for w, v in found[1].items():
        assert sum(v) == (train.count() if w == H.END else counts[w.encode()]) and all(x * H.FINE == round(x * H.FINE) for x in v)
    assert len(found[1]) == len(counts) + 1 - len(head)
