import numpy as np
import pytest
from helpers import score_table

from prismlake.model import DetectionParams, Polarity
from prismlake.operators import detect as D
from prismlake.operators.library import Library

PLANS = pytest.mark.parametrize("plan", ["candidates", "dense"])


def by_definition(grid, params):
    """A pixel stays if it passes and no other in its window is better, or as good and earlier."""
    lower = params.polarity is Polarity.LOWER
    g = grid.astype(np.float32)
    h, w = g.shape
    out = []
    for y in range(h):
        for x in range(w):
            s = g[y, x]
            if not (s <= np.float32(params.threshold) if lower else s >= np.float32(params.threshold)):
                continue
            r = max(params.nms_radius, 0)
            beaten = False
            for v in range(max(0, y - r), min(h, y + r + 1)):
                for u in range(max(0, x - r), min(w, x + r + 1)):
                    o = g[v, u]
                    beaten |= (v, u) != (y, x) and ((o < s if lower else o > s) or (o == s and v * w + u < y * w + x))
            if not beaten:
                out.append(y * w + x)
    return out


@PLANS
@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("polarity", list(Polarity))
def test_random_grids_with_ties_zeros_and_nan(spark, plan, seed, polarity):
    rng = np.random.default_rng(seed)
    grid = rng.integers(-2, 3, (11, 13)) / 4.0
    grid[rng.random(grid.shape) < 0.1] = np.nan
    grid[rng.random(grid.shape) < 0.1] = -0.0
    params = DetectionParams(0.1, seed + 1, None, polarity)
    got = [r["p"] for r in D.nms(score_table(spark, grid), params, plan).orderBy("p").collect()]
    assert got == by_definition(grid, params)


@PLANS
def test_one_for_each_blob(spark, plan):
    g = np.ones((9, 9))
    g[3:6, 3:6], g[4, 4] = 0.05, 0.01
    assert D.nms(score_table(spark, g), DetectionParams(0.1, 0), plan).count() == 9
    rows = D.detect(score_table(spark, g), DetectionParams(0.1, 2), plan).collect()
    assert [(r["x"], r["y"]) for r in rows] == [(4, 4)] and rows[0]["score"] == pytest.approx(0.01)


@PLANS
def test_plateaus_keep_their_first_pixel(spark, plan):
    g = np.ones((5, 5))
    g[1:3, 1:3] = 0.02
    assert [(r["x"], r["y"]) for r in D.detect(score_table(spark, g), DetectionParams(0.1, 2), plan).collect()] == [(1, 1)]


@PLANS
def test_polarity(spark, plan):
    g = np.full((7, 7), 0.5)
    g[2, 2], g[5, 5] = 0.01, 0.99
    low = D.detect(score_table(spark, g), DetectionParams(0.1, 1), plan).collect()
    high = D.detect(score_table(spark, g), DetectionParams(0.9, 1, polarity=Polarity.HIGHER), plan).collect()
    assert [(r["x"], r["y"]) for r in low] == [(2, 2)] and [(r["x"], r["y"]) for r in high] == [(5, 5)]
    g = np.full((9, 9), 0.5)
    g[3:6, 3:6], g[3, 3], g[5, 5] = 0.8, 0.6, 0.95
    one = D.detect(score_table(spark, g), DetectionParams(0.55, 3, polarity=Polarity.HIGHER), plan).collect()
    assert [(r["x"], r["y"]) for r in one] == [(5, 5)]


def test_thresholds_are_inclusive_in_single_precision(spark):
    g = np.array([[float(np.float32(0.1)), float(np.float32(0.1000001)), np.nan]])
    assert [r["p"] for r in D.threshold(score_table(spark, g), DetectionParams(0.1)).collect()] == [0]
    high = DetectionParams(0.1, polarity=Polarity.HIGHER)
    assert sorted(r["p"] for r in D.threshold(score_table(spark, g), high).collect()) == [0, 1]


def test_cap_counts_on_and_zero_counts_show(spark):
    g = np.zeros((4, 5))
    found = D.detect(score_table(spark, g), DetectionParams(0.1, 0, 7))
    rows = D.first_detections(found, 100).collect()
    assert [(r["y"], r["x"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1)]
    assert {r["detections_found"] for r in rows} == {20}
    lib = Library(("a", "b"), np.ones((2, 3))).frame(spark)
    assert {r["name"]: r["detections"] for r in D.per_target(found, lib).collect()} == {"a": 7, "b": 0}
    assert D.detect(score_table(spark, g), DetectionParams(0.1, 0, None)).count() == 20
    assert D.choose_plan(score_table(spark, g), DetectionParams(0.1)) == "dense"
    assert D.detect(score_table(spark, g).where("false"), DetectionParams()).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 10])
def test_tiles_and_their_halos_by_definition(spark, monkeypatch, radius):
    """Small tiles: windows cross many borders, ties included."""
    monkeypatch.setattr(D, "TILE", 16)
    grid = np.random.default_rng(radius).integers(0, 40, (150, 131)) / 40.0
    params = DetectionParams(0.8, radius)
    got = [r["p"] for r in D.nms(score_table(spark, grid), params).orderBy("p").collect()]
    assert got == by_definition(grid, params)


def test_tiles_get_at_most_twice_the_candidates(spark):
    spread = spark.range(200_000).selectExpr("0L AS frame_index", "id AS p", "cast(id / 500 as int) AS y", "cast(id % 500 as int) AS x", "0 AS target", "rand(3) AS score")
    for radius in (2, 10, 40):
        df = D.nms_candidates(spread, DetectionParams(0.5, radius))
        df.write.format("noop").mode("overwrite").save()
        dealt = spread.where("score <= 0.5")
        side = max(D.TILE, 8 * radius)
        copies = dealt.selectExpr(f"(floor((y + {radius}) / {side}) - floor((y - {radius}) / {side}) + 1) * (floor((x + {radius}) / {side}) - floor((x - {radius}) / {side}) + 1) AS k").agg({"k": "avg"}).first()[0]
        assert copies <= 2


def test_running_minimum():
    rng = np.random.default_rng(0)
    for n, r in ((1, 1), (7, 2), (30, 10), (5, 10), (9, 4)):
        a = rng.integers(0, 99, (3, n))
        want = [[a[i, max(0, k - r) : k + r + 1].min() for k in range(n)] for i in range(3)]
        assert (D.running_minimum(a, r, 1) == want).all() and (D.running_minimum(a.T.copy(), r, 0).T == want).all()


def test_repeated_rows_and_negative_places(spark):
    rows = [(0, 5, 1, 1, 0, 0.1), (0, 5, 1, 1, 0, 0.1), (0, 6, -1, -1, 0, 0.05), (1, 5, 1, 1, 0, 0.2)]
    df = spark.createDataFrame(rows, "frame_index long, p long, y int, x int, target int, score double")
    assert sorted((r["frame_index"], r["p"]) for r in D.nms(df, DetectionParams(0.5, 1)).collect()) == [(0, 5), (0, 6), (1, 5)]
    assert D.nms(df.where("false"), DetectionParams(0.5, 1)).count() == 0


def test_the_cap_of_a_frame_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 100)
    df = spark.range(20_000).selectExpr("id % 2 AS frame_index", "div(id, 2) * 3 AS p", "cast(div(id, 2) as int) AS y", "cast(0 as int) AS x", "0 AS target", "0.01D AS score")
    for cap in (1, 99, 3333, None):
        got = D.detect(df, DetectionParams(0.1, 0, cap)).collect()
        kept = {f: sorted(r["y"] for r in got if r["frame_index"] == f) for f in (0, 1)}
        assert kept == {f: list(range(min(10_000, cap or 10_000))) for f in (0, 1)} and {r["detections_found"] for r in got} == {10_000}
