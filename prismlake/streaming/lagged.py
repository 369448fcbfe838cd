"""Lagged statistics of many streams at once, kept in Spark's state.

Each task turns the pixels of a frame into one row of moments; what is shuffled
by stream are those rows, not pixels. A stateful operator holds for each stream
the moments of its open frame and the mean of the frame before, and gives each
frame the statistics about that lagged mean. State is checkpointed with the
stream, so a query that is killed goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.moments import Moments, dense

#: The state store that Spark's stateful operator needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames that a task holds moments of at once.
OPEN_FRAMES = 64
#: Shares in which a frame's rows are merged first.
SHARES = 32
PARTIAL = "stream string, frame_index long, n double, mean array<double>, products array<double>"
LAGGED = "stream string, frame_index long, n double, mean array<double>, covariance array<double>, lagged_mean array<double>, lagged_products array<double>"
_STATE = "frame_index long, n double, mean array<double>, products array<double>, lagged_mean array<double>"


def _rows(held: dict[tuple[str, int], Moments]) -> pa.RecordBatch:
    parts, doubles = list(held.values()), pa.list_(pa.float64())
    columns = [pa.array([k[0] for k in held], pa.string()), pa.array([int(k[1]) for k in held], pa.int64()), pa.array([m.n for m in parts], pa.float64()), pa.array([m.centre for m in parts], doubles), pa.array([m.products.reshape(-1) for m in parts], doubles)]
    return pa.RecordBatch.from_arrays(columns, names=["stream", "frame_index", "n", "mean", "products"])


def frame_moments(pixels: DataFrame, stream_col: str = "stream", column: str = "spectrum") -> DataFrame:
    """One row (stream, frame_index, n, mean, products) for each stream and frame of a task, more only if it has many frames; works on tables and streams. Null spectra are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Moments] = {}
        for b in batches:
            b = b.filter(b["spectrum"].is_valid())
            keys = pd.MultiIndex.from_arrays([b["stream"].to_pandas(), b["frame_index"].to_numpy(zero_copy_only=False)])
            codes, found = pd.factorize(keys)
            x = dense(b["spectrum"])
            for k, key in enumerate(found):
                one = Moments.of(x[codes == k])
                held[key] = held[key].merge(one) if key in held else one
            if len(held) > OPEN_FRAMES:
                yield _rows(held)
                held.clear()
        if held:
            yield _rows(held)

    named = pixels.select(F.coalesce(F.col(stream_col).cast("string"), F.lit("")).alias("stream"), "frame_index", F.col(column).alias("spectrum"))
    return named.mapInArrow(run, PARTIAL)


def _moments(n, mean, products) -> Moments:
    mean = np.asarray(mean, dtype=np.float64)
    return Moments(float(n), mean, np.asarray(products, dtype=np.float64).reshape(len(mean), len(mean)))


def _merged(frames: Iterator[pd.DataFrame]) -> dict[int, Moments]:
    """The moments of each frame from its rows, in the order of frames."""
    found: dict[int, Moments] = {}
    for f in frames:
        for k, n, mean, products in zip(f["frame_index"], f["n"], f["mean"], f["products"], strict=True):
            one = _moments(n, mean, products)
            found[int(k)] = found[int(k)].merge(one) if int(k) in found else one
    return dict(sorted(found.items()))


def _about(m: Moments, reference: np.ndarray | None) -> np.ndarray | None:
    """Sums of products of differences from a reference."""
    if reference is None:
        return None
    apart = m.centre - reference
    return m.products + m.n * np.outer(apart, apart)


class LaggedProcessor(StatefulProcessor):
    """For each stream: the open frame's moments, and the mean of the frame before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = lagged = None
        if self.open.exists():
            frame, n, mean, products, lagged = self.open.get()
            at, current = int(frame), _moments(n, mean, products)
            lagged = None if lagged is None else np.asarray(lagged, dtype=np.float64)
        out = []
        for frame, m in _merged(rows).items():
            if at is not None and frame < at:
                raise ValueError(f"stream {key[0]!r}: frame {frame} comes after frame {at}")
            if at == frame:
                current = current.merge(m)  # the rest of a frame that was cut by a micro-batch
            else:
                lagged = current.centre if at is not None else None
                at, current = frame, m
            about = _about(current, lagged)
            out.append((key[0], at, current.n, current.centre, current.covariance().reshape(-1), lagged, None if about is None else about.reshape(-1)))
        self.open.update((at, current.n, current.centre.tolist(), current.products.reshape(-1).tolist(), None if lagged is None else lagged.tolist()))
        yield pd.DataFrame(out, columns=["stream", "frame_index", "n", "mean", "covariance", "lagged_mean", "lagged_products"])

    def close(self) -> None:
        pass


def lagged_stream(pixels: DataFrame, stream_col: str = "stream", column: str = "spectrum") -> DataFrame:
    """A stream of statistics from a stream of pixels (stream_col, frame_index, spectrum): one row for each stream and frame.

    stream, frame_index, n, mean, covariance (of the population, row by row),
    lagged_mean (of the frame before, null for a stream's first one) and
    lagged_products, the sums of products of differences from it. Frames of a
    stream must come in order, however many streams there are; one that comes late
    stops the query. A frame that is cut by a micro-batch has a row in both, and
    the later one is the whole. A null stream counts as an empty name; frames
    without spectra have no row.
    """
    pixels.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return frame_moments(pixels, stream_col, column).groupBy("stream").transformWithStateInPandas(LaggedProcessor(), LAGGED, "append", "none")


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, those of a frame together, to one row for each frame; a frame is held at a time, and finished ones until a batch ends."""
    done: dict[tuple[str, int], Moments] = {}
    key = current = None
    for b in batches:
        for name, frame, n, mean, products in zip(*(b[c].to_pylist() for c in ("stream", "frame_index", "n", "mean", "products")), strict=True):
            one = _moments(n, mean, products)
            if key == (name, frame):
                current = current.merge(one)
            else:
                if key is not None:
                    done[key] = current
                key, current = (name, frame), one
        if done:
            yield _rows(done)
            done.clear()
    if key is not None:
        yield _rows({key: current})


def lagged_table(pixels: DataFrame, stream_col: str = "stream", column: str = "spectrum") -> DataFrame:
    """The same rows from a table: frames are merged apart, and each looks at the one before it by a window over rows of frames.

    A frame of many tasks is merged in SHARES shares first, so its rows don't all meet in one task.
    """
    frame = ("stream", "frame_index")
    parts = frame_moments(pixels, stream_col, column).withColumn("share", F.spark_partition_id() % SHARES)
    some = parts.repartition(*frame, "share").sortWithinPartitions(*frame).drop("share").mapInArrow(_merge_runs, PARTIAL)
    whole = some.repartition(*frame).sortWithinPartitions(*frame).mapInArrow(_merge_runs, PARTIAL).withColumn("covariance", F.transform("products", lambda v: v / F.col("n")))
    with_lag = whole.withColumn("lagged_mean", F.lag("mean").over(Window.partitionBy("stream").orderBy("frame_index")))
    apart = F.zip_with("mean", "lagged_mean", lambda a, b: a - b)
    cross = F.flatten(F.transform(apart, lambda a: F.transform(apart, lambda b: a * b)))
    about = F.when(F.col("lagged_mean").isNotNull(), F.zip_with("products", cross, lambda p, c: p + F.col("n") * c))
    return with_lag.select("stream", "frame_index", "n", "mean", "covariance", "lagged_mean", about.alias("lagged_products"))


def last_of_each(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rows that a stream has written, the whole one of each frame: that of the most pixels."""
    rows = spark.read.schema(LAGGED).parquet(folder)
    return rows.groupBy("stream", "frame_index").agg(F.max_by(F.struct("n", "mean", "covariance", "lagged_mean", "lagged_products"), "n").alias("r")).select("stream", "frame_index", "r.*")
