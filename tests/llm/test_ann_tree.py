import math

import numpy as np
import pytest

from prismlake.llm import ann_tree as A


def brute(rows, k=5, every=50):
    rows = {i: np.array(v, dtype=float) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in rows.items():
        if i % every == 0:
            s = sorted(((-round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 12), j) for j, v in rows.items() if j != i))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def test_few_rows_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # copies of one vector
    rows += [(300, None), (350, [0.0] * 6), (400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (450, [float("nan")] * 6), (500, [float("inf")] + [1.0] * 5), (550, [])]
    result, said = A.nearest(table(spark, [(i, v, 1) for i, v in rows]), recall=1.0)
    expected = brute(rows)
    got = {}
    for r in result.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(expected) == {0, 50, 100, 200, 250}
    for q, near in expected.items():
        assert [j for j, _ in got[q]] == [j for j, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)
    assert said["recall"] == 1.0


def test_fewer_candidates_than_wanted_and_large_values(spark):
    rows = [(0, [1e200, 1e200], 1), (1, [1e-200, 0.0], 1), (2, [1.0, 1.0], 1)]
    got = A.nearest(table(spark, rows, "double"))[0].orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)] and got[1]["score"] == pytest.approx(math.sqrt(0.5))
    assert A.nearest(table(spark, rows).where("false"))[0].count() == 0
    assert A.nearest(table(spark, [(0, [1.0], 1)]))[0].count() == 0


def test_recall_on_the_sample_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    result, said = A.nearest(df)
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    x, ids = np.array([v for _, v in rows], dtype=float), np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in result.collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    found = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.sort(np.delete(x @ x[i], i))[::-1][:5]
        found += sum(v >= s[-1] - 1e-9 for v in got[ids[i]])
        total += 5
    assert found / total >= 0.9 and said["recall"] >= 0.9


def test_every_row_has_a_leaf_and_all_leaves_can_be_visited():
    x = A.unit(np.random.default_rng(0).normal(size=(900, 8)))
    tree = A.fit_tree(x, branches=4, leaf=30)
    assert set(tree.place(x)) <= set(tree.leaves)
    assert sorted(tree.visits(x[0], 10_000)) == sorted(tree.leaves)
    assert A.fit_tree(np.tile(x[:1], (500, 1))).leaves  # equal vectors can't be split


def clustered(n, clusters, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(clusters)] + 0.15 * rng.normal(size=size)]) for i in range(n)]


def found_share(rows, result):
    got = {}
    for r in result.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    expected = brute(rows)
    assert set(got) == set(expected)
    for near in got.values():
        assert sorted(r for r, _ in near) == list(range(1, len(near) + 1))
    return sum(len({j for j, _ in near} & {j for _, j in got[q]}) for q, near in expected.items()) / sum(map(len, expected.values()))


def test_leaves_grow_in_number_and_stay_small(spark, monkeypatch):
    """With a top fitted on few vectors, leaves are split by those placed there, over several levels."""
    monkeypatch.setattr(A, "LEAF", 16)
    monkeypatch.setattr(A, "BLOCK", 300)
    rows = clustered(6000, 60, 12, 4)
    df = table(spark, [(i, v, 1) for i, v in rows]).repartition(4)
    result, said = A.nearest(df, sample=60, leaf_rows=40, leaf_sample=250)
    assert said["levels"] >= 3 and said["leaves"] >= 6000 / 40
    assert said["visits"] < said["leaves"] / 4
    assert found_share(rows, result) >= 0.9 and said["recall"] >= 0.9
    exact, said = A.nearest(df, sample=60, leaf_rows=40, leaf_sample=250, recall=1.0)
    assert said["recall"] == 1.0


def test_vectors_of_one_direction_stay_in_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 50)
    rows = [(i, [1.0 + i, 2.0 + 2 * i]) for i in range(400)] + [(1000 + i, [-1.0, float(i)]) for i in range(30)]
    result, said = A.nearest(table(spark, [(i, v, 1) for i, v in rows], "double"), sample=20, leaf_rows=64, leaf_sample=100)
    assert said["levels"] >= 2
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in result.collect()}
    assert len(got) == 5 * len(brute(rows))
    assert all(s == pytest.approx(1.0, abs=1e-9) for (q, _), (_, s) in got.items() if q < 400)


@pytest.mark.parametrize("n", [1, 3, 4, 40])
def test_best_of_a_block_by_definition(n):
    """Nearest first, ties to the smaller first member, ties with the last included before the cut."""
    rng = np.random.default_rng(n)
    x, q = rng.integers(-2, 3, size=(n, 3)) + 0.25, rng.integers(-2, 3, size=(7, 3)) + 0.25
    frame = lambda m, **more: A.pd.DataFrame({"digest": [bytes([i]) for i in range(len(m))], "vec": [v.astype("<f8").tobytes() for v in m], **more})
    members = [[int(i), int(i) + 1000] for i in rng.permutation(n)]
    got = A._best(frame(q), frame(x, members=members), 4)
    a, b = q / np.abs(q).max(axis=1, keepdims=True), x / np.abs(x).max(axis=1, keepdims=True)
    s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    for i in range(7):
        of = got[got["query"] == bytes([i])]
        assert len(of) == min(n, 4)
        best = sorted(zip(-s[i], [m[0] for m in members], strict=True))[:4]
        assert of["score"].tolist() == pytest.approx([-v for v, _ in best])
        assert (np.diff(of["score"]) <= 0).all()
        # Among equal scores the smaller members come first.
        assert all(m[0] < o[0] for m, o, u, v in zip(of["members"], of["members"][1:], of["score"], of["score"][1:], strict=False) if u == v)
    assert len(A._best(frame(q).iloc[:0], frame(x, members=members), 4)) == 0
