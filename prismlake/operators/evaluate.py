"""Quality of scores against ground truth, and statistics of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Polarity
from .detect import passes

#: Labels above this are annotation bookkeeping and take no part.
LAST_LABEL = 8
_NAN = float("nan")


def labelled(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores with the labels of their pixels; pixels without a valid label are left out, not counted as negatives."""
    return scores.join(truth, ["frame_index", "p"]).where(F.col("label") <= LAST_LABEL)


def confusion(df: DataFrame, target: int, threshold: float, polarity: Polarity | str = Polarity.LOWER) -> DataFrame:
    """tp, fp, fn, tn of the rows (score, label)."""
    said, real = passes(F.col("score"), threshold, polarity), F.col("label") == target
    return df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", said & real), ("fp", said & ~real), ("fn", ~said & real), ("tn", ~said & ~real))])


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """From tp, fp, fn; NaN where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(_NAN))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    both = counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(F.isnan(p) | F.isnan(r), F.lit(_NAN)).otherwise(ratio(2 * p * r, p + r)))


def _won_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a range of scores, worst first: pairs of a positive and a worse negative within it, ties counting half; and the counts."""
    won = pos = neg = 0.0
    for b in batches:
        p, n = b["pos"].to_numpy().astype(np.float64), b["neg"].to_numpy().astype(np.float64)
        before = neg + np.cumsum(n) - n
        won += float((p * (before + n / 2)).sum())
        pos, neg = pos + float(p.sum()), neg + float(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([won]), pa.array([pos]), pa.array([neg])], names=["part", "won", "pos", "neg"])


def roc_auc(df: DataFrame, target: int, polarity: Polarity | str = Polarity.LOWER) -> DataFrame:
    """The area under the ROC curve of (score, label), ties counting half; NaN where a class is empty.

    Rows are first counted by distinct score. Those are dealt to ranges of about as
    many scores each, however they are spread; each range becomes one row, and the
    ranges' rows are put together.
    """
    key = F.col("score").cast("double") if Polarity(polarity) is Polarity.LOWER else -F.col("score").cast("double")
    real = F.col("label") == target
    by_score = df.where(~F.isnan("score")).groupBy((key + 0.0).alias("k")).agg(F.count_if(real).alias("pos"), F.count_if(~real).alias("neg"))
    ranges = by_score.repartitionByRange(F.desc("k")).sortWithinPartitions(F.desc("k")).mapInArrow(_won_pairs, "part int, won double, pos double, neg double")
    # One row for each range.
    worse = F.sum("neg").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("neg")
    total = ranges.withColumn("worse", worse).agg(F.sum(F.col("won") + F.col("pos") * F.col("worse")).alias("u"), F.coalesce(F.sum("pos"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0.0)).alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(F.lit(_NAN)).alias("auc"), F.col("p").cast("long").alias("positives"), F.col("n").cast("long").alias("negatives"))


def class_statistics(df: DataFrame, target: int) -> DataFrame:
    """For each label: n, mean and least score, and how far its mean is above the target's."""
    each = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"))
    # One row for each label: gathered in one task, whatever the number of pixels.
    reference = F.max(F.when(F.col("label") == target, F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    return each.select("label", "n", "mean", "least", (F.col("mean") - reference).alias("gap"))


def background_minimum(df: DataFrame) -> DataFrame:
    return df.where("label = 0").agg(F.min("score").alias("least"))


def agreement(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Two scorings of the same pixels: n, max_error, mismatches of targets, and those whose scores differ by more than tolerance."""
    both = a.select("frame_index", "p", F.col("target").alias("t1"), F.col("score").alias("s1")).join(b.select("frame_index", "p", F.col("target").alias("t2"), F.col("score").alias("s2")), ["frame_index", "p"])
    gap, other = F.abs(F.col("s1") - F.col("s2")), F.col("t1") != F.col("t2")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_error"), F.count_if(other).alias("mismatches"), F.count_if(other & (gap > tolerance)).alias("significant"))


def _running(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to sorted rows (group, v, n) the range's number and how many rows of the group lie before in the range."""
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            codes = np.zeros(b.num_rows, np.int64)
            for c in names:  # a new group begins where any of its columns changes
                column = b.column(c)
                same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False) | (column[1:].is_null().to_numpy(zero_copy_only=False) & column[:-1].is_null().to_numpy(zero_copy_only=False))
                codes[1:] |= ~same
            group = np.cumsum(codes)
            n = b["n"].to_numpy()
            before = np.cumsum(n) - n
            if b.num_rows:
                starts = np.concatenate(([0], np.flatnonzero(codes) if len(codes) else []))
                starts = np.unique(starts).astype(np.int64)
                first = tuple(b.column(c)[0].as_py() for c in names)
                carried = np.zeros(len(starts), np.int64)
                carried[0] = seen if first == last else 0
                before = before - before[starts][group] + carried[group]
                last, seen = tuple(b.column(c)[-1].as_py() for c in names), int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, here, np.int32)), pa.array(before)], names=[*b.schema.names, "part", "before"])

    return run


def percentiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation between two order statistics, one column for each share; null values are left out.

    Distinct values are counted within tasks first, then sorted in ranges of group
    and value. The counts of a group's ranges say where its order statistics lie,
    so a group of any size is spread over tasks and none is held as a whole.
    A group without values has null percentiles.
    """
    by = list(by or [])
    spark = df.sparkSession
    keys = [f"__g{i}" for i in range(len(by))] or ["__g0"]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=bool(by))] if by else [F.lit(0).alias("__g0")], F.col(column).cast("double").alias("v"))
    counted = rows.where("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    fields = ", ".join(f"`{c}` {t}" for c, t in counted.dtypes)
    ranged = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "v").sortWithinPartitions(*keys, "v").mapInArrow(_running(keys), f"{fields}, part int, before long")
    parts = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
    group = Window.partitionBy(*keys)
    offsets = parts.select(*[F.col(k).alias(f"{k}o") for k in keys], F.col("part").alias("parto"), (F.sum("m").over(group.orderBy("part")) - F.col("m")).alias("offset"), F.sum("m").over(group).alias("total"))
    same = F.col("part") == F.col("parto")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}o"))
    first = F.col("offset") + F.col("before")
    covers = lambda rank: (first <= rank) & (rank < first + F.col("n"))
    place = {q: (F.col("total") - 1) * F.lit(float(q)) for q in shares}
    wanted = F.lit(False)
    for q in shares:
        wanted = wanted | covers(F.floor(place[q])) | covers(F.ceil(place[q]))
    found = ranged.join(offsets, same).where(wanted)
    at = lambda rank: F.max(F.when(covers(rank), F.col("v")))
    picked = found.groupBy(*keys).agg(F.max("total").alias("total"), *[at(F.floor(place[q])).alias(f"l{i}") for i, q in enumerate(shares)], *[at(F.ceil(place[q])).alias(f"h{i}") for i, q in enumerate(shares)])
    value = lambda i, q: F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (place[q] - F.floor(place[q]))
    names = [F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise(value(i, q)).alias(f"p{round(100 * q)}") for i, q in enumerate(shares)]
    answers = picked.select(*keys, *names)
    if not by:
        return spark.range(1).select(F.lit(0).alias("__k")).join(answers, F.col("__k") == F.col("__g0"), "left").select(*[f"p{round(100 * q)}" for q in shares])
    groups = rows.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)]).distinct()
    match = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        match = match & groups[c].eqNullSafe(answers[k])
    return groups.join(answers, match, "left").select(*by, *[f"p{round(100 * q)}" for q in shares])


def run_statistics(frames: DataFrame, pixels_per_frame: int, bytes_per_pixel: int) -> DataFrame:
    """One row over frame results (ms, detections_kept): frames, fps, Mpixel/s, GB/s, mean and largest ms, detections."""
    total = frames.agg(F.count(F.lit(1)).alias("frames"), F.sum("ms").alias("ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.sum("detections_kept").alias("total_detections"))
    fps = F.try_divide(F.col("frames") * 1000.0, F.col("ms"))
    return total.select("frames", fps.alias("fps"), (fps * pixels_per_frame / 1e6).alias("mpixels_per_s"), (fps * pixels_per_frame * bytes_per_pixel / 1e9).alias("gb_per_s"), "mean_ms", "max_ms", "total_detections")
