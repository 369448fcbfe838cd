import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import search as S

RIGHT = S.RIGHT_ANGLE


def plain(x, targets):
    """By definition: all angles, the first of the least."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.arccos(np.clip((x @ targets.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(targets, axis=1)[None, :], -1, 1))
    a[:, ~targets.any(axis=1)] = RIGHT
    a[~x.any(axis=1)] = RIGHT
    return a.argmin(axis=1), a.min(axis=1)


def run(index, x):
    target, score = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
    return target, score, index.search(x, target, score)


@pytest.mark.parametrize("bands,targets,spread", [(4, 3000, 1.0), (64, 20_000, 0.05), (64, 500, 1.0), (2, 5, 1.0)])
def test_the_nearest_of_all(bands, targets, spread):
    rng = np.random.default_rng(bands + targets)
    middles = rng.normal(size=(60, bands))
    t = middles[rng.integers(0, 60, targets)] + spread * rng.normal(size=(targets, bands))
    x = middles[rng.integers(0, 60, 700)] + spread * rng.normal(size=(700, bands))
    index = S.build_index(np.arange(targets), t)
    target, score, taken = run(index, x)
    at, angle = plain(x, t)
    assert (target == at).all() and np.abs(score - angle).max() < 1e-9
    if spread < 0.1:  # with structure in the data, most clusters are skipped
        assert taken < 0.1 * len(x) * targets


def test_ties_blanks_and_what_is_no_number():
    t = np.array([[np.nan, 1.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [1e200, 1e200]])
    index = S.build_index(np.array([10, 4, 9, 7, 2, 30]), t)
    x = np.array([[2.0, 0.0], [0.0, 0.0], [-1.0, -0.1], [np.nan, 1.0], [1e-200, 1.0001e-200]])
    target, score, _ = run(index, x)
    assert target.tolist() == [7, 2, 2, -1, 30] and score[:4].tolist() == [0.0, RIGHT, RIGHT, np.inf] and score[4] < 1e-4
    none = S.build_index(np.array([10]), t[:1])
    assert run(none, x)[0].tolist() == [-1] * 5
    assert run(S.build_index(np.array([3, 1]), t[[1, 4]]), x)[0].tolist() == [1, 1, 1, -1, 1]


def test_passes_over_parts_of_the_library(spark, tmp_path):
    rng = np.random.default_rng(8)
    t, x = rng.normal(size=(900, 6)), rng.normal(size=(150, 6))
    t[500] = t[20]
    library = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(t)] + [(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "target_id long, values array<double>")
    pixels = spark.createDataFrame([(i, "c", [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None, None)], "p long, id string, spectrum array<double>")
    at, angle = plain(x, t)
    for size, folder in ((1 << 20, None), (4096, str(tmp_path))):
        rows = S.sam_nearest(pixels, library, folder=folder, part_bytes=size).orderBy("p").collect()
        assert [r["target"] for r in rows] == [*at.tolist(), -1] and np.abs(np.array([r["score"] for r in rows[:-1]]) - angle).max() < 1e-9
        assert rows[-1]["score"] == np.inf and rows[0]["id"] == "c"
    assert len(list(tmp_path.iterdir())) > 5  # a part holds 85 targets
    with pytest.raises(ValueError, match="need a folder"):
        S.sam_nearest(pixels, library, part_bytes=4096)
    with pytest.raises(ValueError, match="bands"):
        S.sam_nearest(pixels, library.union(spark.createDataFrame([(7, [1.0])], library.schema)))
    assert {(r["target"], r["score"]) for r in S.sam_nearest(pixels, library.where("false")).collect()} == {(-1, np.inf)}
    assert S.sam_nearest(pixels.where("false"), library).count() == 0
    with pytest.raises(Exception, match="number of bands"):
        S.sam_nearest(pixels.withColumn("spectrum", F.slice("spectrum", 1, 2)), library).collect()


def test_the_work_of_a_pixel_grows_with_the_depth_of_the_tree():
    rng = np.random.default_rng(21)
    x, taken = rng.uniform(size=(1000, 4)), {}
    for n in (3000, 60_000):
        t = rng.uniform(size=(n, 30, 4)).mean(axis=1)
        target, score, taken[n] = run(S.build_index(np.arange(n), t), x)
        at, angle = plain(x[:200], t)
        assert (target[:200] == at).all() and np.abs(score[:200] - angle).max() < 1e-9
    assert taken[60_000] < 2 * taken[3000]


def test_parts_of_neighbouring_directions_and_of_equal_ones(spark, tmp_path):
    """700 targets of one direction can't be told apart by it, so their part is cut by their ids."""
    rng = np.random.default_rng(22)
    t = np.concatenate([2.0 ** rng.integers(-3, 4, (700, 1)) * np.array([1.0, 2, 4]), rng.uniform(size=(300, 3))])
    x = np.concatenate([rng.uniform(size=(100, 3)), [[1.0, 2, 4], [0, 0, 0]]])
    library = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(t)], "target_id long, values array<double>")
    pixels = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "p long, spectrum array<double>")
    rows = S.sam_nearest(pixels, library, folder=str(tmp_path), part_bytes=2400).orderBy("p").collect()
    at, angle = plain(x, t)
    assert [r["target"] for r in rows[:100]] == at[:100].tolist() and np.abs(np.array([r["score"] for r in rows[:100]]) - angle[:100]).max() < 1e-7
    assert rows[100]["target"] == 0 and rows[100]["score"] < 1e-7 and (rows[101]["target"], rows[101]["score"]) == (0, RIGHT)
