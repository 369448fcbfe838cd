import numpy as np
import pytest
from helpers import correlated_scene, pixel_table

from prismlake.functions.linalg import SingularMatrix
from prismlake.model import DETECTORS, Polarity, detector, strategy
from prismlake.operators import scoring
from prismlake.operators.library import Library
from prismlake.operators.moments import Moments, build_statistics, moments

BOTH = pytest.mark.parametrize("how", ["sql", "arrow"])


def lib(*rows, names=None):
    return Library(tuple(names or (f"t{i}" for i in range(len(rows)))), np.array(rows, dtype=np.float32))


def best(df):
    return {r["p"]: (r["target"], r["score"]) for r in df.collect()}


@BOTH
def test_zero_angle_on_itself(spark, how):
    t = [0.1, 0.4, 0.9, 0.3, 0.2, 0.7, 0.5, 0.6]
    target, score = best(scoring.sam_best(pixel_table(spark, np.array([[t]])), lib(t), strategy=how))[0]
    assert target == 0 and score == pytest.approx(0, abs=1e-3)


@BOTH
def test_gain_does_not_matter(spark, how):
    rng = np.random.default_rng(1)
    x, t = rng.uniform(0.05, 1, 16), rng.uniform(0.05, 1, 16)
    cube = np.array([[x * g for g in (1, 0.01, 0.5, 3, 250)]])
    scores = [s for _, s in best(scoring.sam_best(pixel_table(spark, cube), lib(t), strategy=how)).values()]
    assert np.ptp(scores) < 1e-4


@BOTH
def test_orthogonal_and_empty_pixels(spark, how):
    cube = np.array([[[0, 1, 0, 1], [0, 0, 0, 0]]], dtype=float)
    for _, s in best(scoring.sam_best(pixel_table(spark, cube), lib([1, 0, 1, 0]), strategy=how)).values():
        assert s == pytest.approx(np.pi / 2, abs=1e-5)


@BOTH
def test_nearest_target_and_all_targets_agree(spark, how):
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    library = lib([1, 0, 0, 0, 0, 0], 2 * x, x[::-1])
    px = pixel_table(spark, x[None, None])
    assert best(scoring.sam_best(px, library, strategy=how))[0] == (1, pytest.approx(0, abs=1e-3))
    angles = {r["target"]: r["angle"] for r in scoring.sam_all(px, library).collect()}
    assert min(angles, key=angles.get) == 1 and len(angles) == 3


@BOTH
def test_ties_go_to_the_lower_id_and_nothing_to_compare_gives_none(spark, how):
    px = pixel_table(spark, np.array([[[1.0, 2.0], [np.nan, 1.0]]]))
    got = best(scoring.sam_best(px, lib([2, 4], [1, 2], [4, 8]), strategy=how))
    assert got[0][0] == 0
    assert got[1] == (-1, float("inf"))
    assert best(scoring.sam_best(px, Library((), np.zeros((0, 0)))))[0] == (-1, float("inf"))


def test_registry():
    assert [DETECTORS[n].polarity for n in ("sam", "rx", "ace", "cem")] == [Polarity.LOWER] + [Polarity.HIGHER] * 3
    assert detector(" SAM ").needs_targets and not detector("rx").needs_targets and strategy("NumPy") == "arrow"
    with pytest.raises(ValueError, match="known"):
        detector("xyz")


def planted(seed, bands, shape=(40, 48)):
    cube, directions = correlated_scene(seed, *shape, bands)
    anomaly = np.linspace(1.2, 0.1, bands) * (1 + 0.5 * np.cos(np.arange(bands)))
    h, w = shape
    places = [h * w // 7, h * w // 3, 2 * h * w // 3]
    for p in places:
        cube[p // w, p % w] = anomaly
    return cube.astype(np.float32), anomaly, directions, places


@BOTH
def test_rx_ranks_anomalies_first(spark, how):
    cube, _, _, places = planted(4, 16)
    px = pixel_table(spark, cube)
    stats = build_statistics(moments(px), loading=1e-6)
    scores = {r["p"]: r["score"] for r in scoring.rx(px, stats, strategy=how).collect()}
    assert min(scores[p] for p in places) > max(s for p, s in scores.items() if p not in places)


def test_rx_mean_is_about_the_number_of_bands(spark):
    cube, _ = correlated_scene(6, 60, 60, 12)
    px = pixel_table(spark, cube)
    mean = scoring.rx(px, build_statistics(moments(px), loading=1e-9)).groupBy().avg("score").first()[0]
    assert 0.8 * 12 < mean < 1.05 * 12


@BOTH
def test_ace_is_bounded_names_the_target_and_has_rx_beside_it(spark, how):
    cube, anomaly, directions, places = planted(7, 14)
    px = pixel_table(spark, cube)
    stats = build_statistics(moments(px), lib(anomaly, directions[0]), 1e-6)
    got = {r["p"]: r for r in scoring.ace_best(px, stats, strategy=how, with_rx=True).collect()}
    rx = {r["p"]: r["score"] for r in scoring.rx(px, stats).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[p]["target"] == 0 and got[p]["score"] >= 0.9 for p in places)
    assert all(abs(r["rx"] - rx[p]) < 1e-3 for p, r in got.items())


@BOTH
def test_cem_is_one_on_target_and_low_elsewhere(spark, how):
    cube, anomaly, _, places = planted(8, 14)
    px = pixel_table(spark, cube)
    got = best(scoring.cem_best(px, build_statistics(moments(px), lib(anomaly), 1e-6), strategy=how))
    assert all(0.8 < got[p][1] < 1.2 for p in places)
    assert max(s for p, (_, s) in got.items() if p not in places) < 0.8


@BOTH
def test_ace_without_usable_targets(spark, how):
    cube, _ = correlated_scene(9, 4, 5, 4)
    px = pixel_table(spark, cube)
    m = moments(px)
    stats = build_statistics(m, Library(("mean",), m.mean()[None]), 1e-3)
    assert set(best(scoring.ace_best(px, stats, strategy=how)).values()) == {(-1, 0.0)}


def test_statistics_follow_their_definitions():
    cube, _ = correlated_scene(10, 20, 20, 14)
    x = cube.reshape(-1, 14)
    m = Moments.of(x)
    targets = x[:3] + 0.2
    stats = build_statistics(m, lib(*targets), 1e-5)
    assert np.abs(np.triu(stats.whitener, 1)).max() == 0
    y = x[7] - stats.mean
    inverse = np.linalg.inv(m.covariance(1e-5))
    assert ((stats.whitener @ y) ** 2).sum() == pytest.approx(y @ inverse @ y, rel=1e-4)
    d = np.float32(targets[1]).astype(float) - stats.mean
    ace = (y @ inverse @ d) ** 2 / ((d @ inverse @ d) * (y @ inverse @ y))
    z, u = stats.whitener @ y, stats.target_white[1]
    assert (z @ u) ** 2 / ((z @ z) * (u @ u)) == pytest.approx(ace, rel=1e-4)
    assert (stats.cem_weight * np.float32(targets)).sum(axis=1) == pytest.approx(1, abs=1e-3)
    narrow = build_statistics(m, lib(*targets), 1e-5, narrow=True)
    assert (narrow.mean == narrow.mean.astype(np.float32)).all()


def test_singular_scenes_and_other_bands_are_refused():
    x = np.random.default_rng(2).uniform(size=(50, 4))
    x[:, 1] = x[:, 0]
    x -= x.mean(axis=0)
    with pytest.raises(SingularMatrix, match="loading"):
        build_statistics(Moments(50.0, np.zeros(4), np.ones((4, 4))), loading=0.0)
    build_statistics(Moments.of(x), loading=1e-3)
    with pytest.raises(ValueError, match="bands"):
        build_statistics(Moments.of(x), lib([1, 2, 3]), 1e-3)
    with pytest.raises(ValueError, match="library"):
        scoring.score(None, "sam")
    with pytest.raises(ValueError, match="statistics"):
        scoring.score(None, "rx")


def test_blocks_of_targets_give_the_best_of_all(monkeypatch):
    from prismlake.operators import scoring as S

    rng = np.random.default_rng(8)
    x, targets = rng.normal(size=(50, 6)), rng.normal(size=(97, 6))
    targets[90] = targets[3]  # a tie over blocks goes to the lower id
    x[0], x[1], x[2] = np.nan, 0, targets[3]
    norms = np.sqrt((targets * targets).sum(axis=1))
    whole = S._first_best(S._angles(x, targets, norms), True, np.inf)
    monkeypatch.setattr(S, "TARGET_BLOCK", 10)
    parts = S._nearest(x, targets, norms)
    assert (parts["target"] == whole["target"]).all() and (parts["score"] == whole["score"]).all() and parts["target"][0] == -1 and parts["target"][2] == 3
