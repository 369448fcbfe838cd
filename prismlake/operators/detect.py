"""From scores to detections: threshold, suppression of non-maxima, cap.

Scores are compared as 32-bit floats, so that a threshold of 0.1 includes a
score of 0.1 that was computed in single precision. NaN passes no threshold and
suppresses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DetectionParams, Polarity

#: Share of pixels that pass the threshold from which the dense form of suppression pays.
DENSE_SHARE = 0.1
#: Side of a tile in pixels, larger for radii above an eighth of it.
TILE = 256
#: Places of a frame whose detections are numbered together.
BLOCK = 1 << 16


def _lower(polarity: Polarity | str) -> bool:
    return Polarity(polarity) is Polarity.LOWER


def passes(score: Column, threshold: float, polarity: Polarity | str) -> Column:
    s, t = score.cast("float"), F.lit(threshold).cast("float")
    return ~F.isnan(s) & ((s <= t) if _lower(polarity) else (s >= t))


def rank_key(score: Column, polarity: Polarity | str) -> Column:
    """Smaller is better; null for NaN. Zeros of either sign are equal."""
    s = score.cast("float")
    s = s if _lower(polarity) else -s
    return F.when(~F.isnan(s), s + F.lit(0.0).cast("float"))


def threshold(scores: DataFrame, params: DetectionParams) -> DataFrame:
    return scores.where(passes(F.col("score"), params.threshold, params.polarity))


def running_minimum(a: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """The least of each window of 2 * radius + 1 along an axis, windows cut at the ends.

    Blocks as wide as a window hold minima from their start and from their end;
    any window is the end of one and the start of the next.
    """
    a = np.moveaxis(a, axis, -1)
    n, w = a.shape[-1], 2 * radius + 1
    worst = np.iinfo(a.dtype).max
    padded = np.full((*a.shape[:-1], -(-(n + 2 * radius) // w) * w), worst, a.dtype)
    padded[..., radius : radius + n] = a
    blocks = padded.reshape(*a.shape[:-1], -1, w)
    starts = np.minimum.accumulate(blocks, axis=-1).reshape(padded.shape)
    ends = np.minimum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(np.minimum(ends[..., :n], starts[..., w - 1 : w - 1 + n]), -1, axis)


def _best_of_tile(side: int, radius: int, columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        y0, x0 = table["__ty"][0].as_py() * side - radius, table["__tx"][0].as_py() * side - radius
        y, x = table["y"].to_numpy() - y0, table["x"].to_numpy() - x0
        # Smaller is better: 32 bits of the key in the order of floats, then the place of the pixel among the tile's.
        bits = table["__key"].to_numpy().astype(np.float32).view(np.int32).astype(np.int64)
        key = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) << 31
        place = np.empty(len(y), np.int64)
        place[np.argsort(table["p"].to_numpy(), kind="stable")] = np.arange(len(y))
        key += place
        grid = np.full((side + 2 * radius, side + 2 * radius), np.iinfo(np.int64).max)
        np.minimum.at(grid, (y, x), key)
        best = running_minimum(running_minimum(grid, radius, 1), radius, 0)
        own = (y >= radius) & (y < radius + side) & (x >= radius) & (x < radius + side)
        return table.filter(pa.array(own & (best[y, x] == key))).select(columns)

    return run


def nms_candidates(scores: DataFrame, params: DetectionParams) -> DataFrame:
    """Suppression among the pixels that pass the threshold.

    What suppresses a pixel is at least as good and so passes as well; hence only
    candidates are shuffled, to tiles of the frame. A tile also gets those that lie
    within the radius around it: at most 1.6 rows a candidate whatever the radius,
    and no tile holds more than its places. A running minimum over rows and columns
    then finds the best of each window. Of repeated rows of a pixel, one stays.
    """
    kept = threshold(scores, params)
    r = params.nms_radius
    if r <= 0:
        return kept
    side = max(TILE, 8 * r)
    over = lambda c: F.sequence(F.floor((F.col(c) - r) / side).cast("int"), F.floor((F.col(c) + r) / side).cast("int"))
    dealt = kept.withColumn("__key", rank_key(F.col("score"), params.polarity)).withColumn("__ty", F.explode(over("y"))).withColumn("__tx", F.explode(over("x")))
    return dealt.groupBy("frame_index", "__ty", "__tx").applyInArrow(_best_of_tile(side, r, kept.columns), kept.schema)


def nms_dense(scores: DataFrame, params: DetectionParams) -> DataFrame:
    """Suppression as a minimum over rows, then over columns, of (score, index); for many candidates. All pixels take part."""
    r = params.nms_radius
    if r <= 0:
        return threshold(scores, params)
    key = rank_key(F.col("score"), params.polarity)
    ranked = scores.withColumn("__k", F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("p").alias("p"))))
    along = Window.partitionBy("frame_index", "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy("frame_index", "x").orderBy("y").rangeBetween(-r, r)
    best = ranked.withColumn("__m", F.min("__k").over(along)).withColumn("__m", F.min("__m").over(down))
    return threshold(best.where(F.col("__m.p") == F.col("p")).drop("__k", "__m"), params)


def nms(scores: DataFrame, params: DetectionParams, plan: str = "candidates") -> DataFrame:
    if plan not in ("candidates", "dense"):
        raise ValueError("the plan is 'candidates' or 'dense'")
    return (nms_dense if plan == "dense" else nms_candidates)(scores, params)


def choose_plan(scores: DataFrame, params: DetectionParams) -> str:
    """The plan for the share of pixels that pass; costs one pass over the scores."""
    share = scores.agg(F.avg(passes(F.col("score"), params.threshold, params.polarity).cast("int")).alias("s")).first()["s"]
    return "dense" if (share or 0.0) > DENSE_SHARE else "candidates"


def detect(scores: DataFrame, params: DetectionParams = DetectionParams(), plan: str = "candidates") -> DataFrame:
    """frame_index, x, y, target, score, detections_found: at most the cap of each frame, first rows and columns first.

    detections_found counts a frame's detections before the cap.
    """
    # Ranks within blocks of places, and the counts of the blocks before: no task gets a whole frame.
    block = Window.partitionBy("frame_index", "__block")
    found = nms(scores, params, plan).withColumn("__block", F.floor(F.col("p") / BLOCK))
    within = found.withColumn("__r", F.row_number().over(block.orderBy("p")))
    counts = within.groupBy("frame_index", "__block").agg(F.max("__r").cast("long").alias("__n"))
    frame = Window.partitionBy("frame_index")
    before = counts.select("frame_index", "__block", (F.sum("__n").over(frame.orderBy("__block")) - F.col("__n")).alias("__before"), F.sum("__n").over(frame).alias("detections_found"))
    if params.max_detections is not None:
        before = before.where(F.col("__before") < params.max_detections)
    placed = within.join(before, ["frame_index", "__block"])
    if params.max_detections is not None:
        placed = placed.where(F.col("__before") + F.col("__r") <= params.max_detections)
    return placed.select("frame_index", "x", "y", "target", F.col("score").cast("float").alias("score"), "detections_found")


def per_target(detections: DataFrame, library: DataFrame) -> DataFrame:
    """Detections of each target, zeros included."""
    counted = detections.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return library.select("target_id", "name").join(counted, library["target_id"] == counted["target"], "left").select("target_id", "name", F.coalesce("n", F.lit(0)).alias("detections"))


def first_detections(detections: DataFrame, n: int) -> DataFrame:
    return detections.orderBy("frame_index", "y", "x").limit(n)


def on_target(detections: DataFrame, truth: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(hits, false positives): detections on a pixel whose label is their target + 1, and the others."""
    placed = detections.withColumn("p", F.col("y").cast("long") * width + F.col("x"))
    marked = truth.where("label > 0").select("frame_index", "p", (F.col("label") - 1).cast("int").alias("target"))
    keys = ["frame_index", "p", "target"]
    return placed.join(marked, keys, "left_semi"), placed.join(marked, keys, "left_anti")
