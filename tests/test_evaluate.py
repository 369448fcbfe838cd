import math

import numpy as np
import pytest

from prismlake.model import Polarity
from prismlake.operators import evaluate as E


def table(spark, scores, labels):
    return spark.createDataFrame([(0, i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "frame_index long, p long, score double, label int")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("polarity", list(Polarity))
def test_auc_is_the_share_of_ordered_pairs(spark, seed, polarity):
    rng = np.random.default_rng(seed)
    s, y = rng.integers(-4, 9, 60) / 3, rng.integers(0, 3, 60)
    s[0] = np.inf
    better = (lambda a, b: a < b) if polarity is Polarity.LOWER else (lambda a, b: a > b)
    pairs = [(1.0 if better(a, b) else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y != 1]]
    row = E.roc_auc(table(spark, s, y), 1, polarity).first()
    assert row["auc"] == pytest.approx(np.mean(pairs)) and row["positives"] == (y == 1).sum()


def test_auc_without_a_class_is_nan(spark):
    assert math.isnan(E.roc_auc(table(spark, [1, 2], [0, 0]), 1).first()["auc"])
    assert math.isnan(E.roc_auc(table(spark, [], []), 1).first()["auc"])
    assert E.roc_auc(table(spark, [1, 1], [0, 1]), 1).first()["auc"] == 0.5


def test_counts_and_rates(spark):
    df = table(spark, [0.1, 0.2, 0.9, 0.05, np.nan], [1, 0, 1, 1, 1])
    row = E.precision_recall_f1(E.confusion(df, 1, 0.2)).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (2, 1, 2, 0)
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == 0.5 and row["f1"] == pytest.approx(4 / 7)
    none = E.precision_recall_f1(E.confusion(df, 1, -1)).first()
    assert math.isnan(none["precision"]) and none["recall"] == 0 and math.isnan(none["f1"])


def test_labels_above_the_last_are_left_out(spark):
    scores = table(spark, [0.1, 0.2, 0.3], [0, 0, 0]).drop("label")
    truth = spark.createDataFrame([(0, 0, 1), (0, 1, 255), (0, 2, 0)], "frame_index long, p long, label int")
    df = E.labelled(scores, truth)
    assert df.count() == 2
    stats = {r["label"]: r for r in E.class_statistics(df, 1).collect()}
    assert stats[0]["gap"] == pytest.approx(0.2) and stats[1]["n"] == 1
    assert E.background_minimum(df).first()["least"] == pytest.approx(0.3)


def test_agreement_and_percentiles(spark):
    a = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 2, 0.7), (0, 2, 2, 0.1)], "frame_index long, p long, target int, score double")
    b = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 0, 0.7), (0, 2, 1, 0.2)], "frame_index long, p long, target int, score double")
    row = E.agreement(a, b, 0.01).first()
    assert (row["n"], row["mismatches"], row["significant"]) == (3, 2, 1) and row["max_error"] == pytest.approx(0.1)
    v = np.random.default_rng(0).uniform(size=101)
    got = E.percentiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", [0.5, 0.99]).first()
    assert (got["p50"], got["p99"]) == (pytest.approx(np.percentile(v, 50)), pytest.approx(np.percentile(v, 99)))


def test_run_statistics(spark):
    df = spark.createDataFrame([(10.0, 3), (30.0, 1)], "ms double, detections_kept long")
    row = E.run_statistics(df, 1000, 400).first()
    assert (row["frames"], row["fps"], row["max_ms"], row["total_detections"]) == (2, 50.0, 30.0, 4)
    assert row["mpixels_per_s"] == pytest.approx(0.05) and row["gb_per_s"] == pytest.approx(0.02)


def test_percentiles_of_hot_groups_nulls_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", 1, float(v)) for v in rng.normal(size=3000)] + [("ties", 1, 2.0)] * 50 + [("one", 2, 7.5), (None, None, 1.0), (None, None, 2.0), ("none", 3, None), ("hot", 1, None)]
    df = spark.createDataFrame(rows, "kind string, number int, value double").repartition(9)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["kind"], r["number"]): r for r in E.percentiles(df, "value", shares, ["kind", "number"]).collect()}
    assert set(got) == {(k, n) for k, n, _ in rows}
    for key, r in got.items():
        values = [v for k, n, v in rows if (k, n) == key and v is not None]
        for q in shares:
            assert r[f"p{round(100 * q)}"] == (None if not values else pytest.approx(np.percentile(values, 100 * q), abs=1e-12)), (key, q)
    whole = E.percentiles(df, "value", [0.5]).first()
    assert whole["p50"] == pytest.approx(np.percentile([v for *_, v in rows if v is not None], 50))
    assert E.percentiles(df.where("false"), "value", [0.5]).first()["p50"] is None and E.percentiles(df.where("false"), "value", [0.5], ["kind"]).count() == 0


def test_no_task_holds_a_whole_group(spark):
    """One group with all rows is dealt to all ranges about evenly."""
    df = spark.range(40_000).selectExpr("1 AS g", "rand(1) AS value")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        counted = df.groupBy("g", "value").count()
        sizes = counted.repartitionByRange(8, "g", "value").rdd.glom().map(len).collect()
        assert max(sizes) < 40_000 / 4 and E.percentiles(df, "value", [0.5], ["g"]).first()["p50"] == pytest.approx(np.percentile([r["value"] for r in df.collect()], 50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_auc_with_an_outlier_is_spread_over_tasks(spark):
    df = spark.range(30_000).selectExpr("0L AS frame_index", "id AS p", "CASE WHEN id = 0 THEN 1e9 ELSE rand(2) END AS score", "cast(id % 3 as int) AS label")
    rows = df.collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["label"] for r in rows])
    order = np.argsort(np.argsort(-s)) + 1.0  # lower is better: ranks from the worst
    pos = y == 1
    want = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert E.roc_auc(df, 1).first()["auc"] == pytest.approx(want, abs=1e-12)
    keys = df.select((-E.F.col("score")).alias("k")).repartitionByRange(4, "k").rdd.glom().map(len).collect()
    assert max(keys) < 15_000
