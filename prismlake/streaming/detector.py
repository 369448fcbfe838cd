"""Detection on streams of frames, in micro-batches.

Suppression compares neighbours within a frame, which streaming plans can't
express with windows other than of time; each micro-batch holds whole frames and
is handled as a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..model import DetectionParams, detector
from ..operators import scoring
from ..operators.detect import detect
from ..operators.library import Library
from ..operators.moments import Moments, build_statistics, moments


class LaggedStatistics:
    """Statistics for a batch from the mean of the batch before it.

    Sums are taken of differences from the last mean, which keeps digits in one
    pass over the pixels; the first batch has no predecessor and takes its own
    mean first.
    """

    def __init__(self, library: Library | None, loading: float):
        self.library, self.loading, self.reference = library, loading, None

    def next(self, pixels: DataFrame) -> tuple[object, Moments]:
        if self.reference is None:
            self.reference = moments(pixels).mean()
        got = moments(pixels, reference=self.reference)
        self.reference = got.mean()
        return build_statistics(got, self.library, self.loading), got


def score_batch(pixels: DataFrame, name: str, library: Library | None, statistics: LaggedStatistics | None, strategy: str = "auto") -> DataFrame:
    stats = statistics.next(pixels)[0] if statistics is not None else None
    return scoring.score(pixels, name, library, stats, strategy=strategy)


def run_stream(
    pixels: DataFrame, library: Library | None, params: DetectionParams, sink: Callable[[DataFrame, DataFrame, int], None], detector_name: str = "sam",
    loading: float = 1e-6, checkpoint: str | None = None, trigger: dict | None = None, keep_scores: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start detection on a stream of pixels.

    sink gets each batch's detections, its frame results (frame_index,
    detections_found, detections_kept, ms: the batch's time for scores,
    suppression and counts, by its number of frames) in the order of frames, and the batch's number. A batch that runs again after a
    failure has the same number. keep_scores, if given, gets the whole score maps.
    """
    traits = detector(detector_name)
    statistics = LaggedStatistics(library, loading) if traits.needs_statistics else None

    def handle(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            scores = score_batch(batch, detector_name, library, statistics).persist()
            try:
                found = detect(scores, params)
                if keep_scores is not None:
                    keep_scores(scores, number)
                counted = found.groupBy("frame_index").agg(F.max("detections_found").alias("detections_found"), F.count(F.lit(1)).alias("detections_kept"))
                frames = scores.select("frame_index").distinct().join(counted, "frame_index", "left").na.fill(0).persist()
                # Scored, suppressed and counted here, so that the time is that of the work.
                n = max(1, frames.count())
                ms = 1000 * (time.perf_counter() - began) / n
                try:
                    sink(found, frames.withColumn("ms", F.lit(ms)).orderBy("frame_index"), number)
                finally:
                    frames.unpersist()
            finally:
                scores.unpersist()
        finally:
            batch.unpersist()

    writer = pixels.writeStream.foreachBatch(handle)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def expected_reads(bands: int, block: int = 32) -> int:
    """How often a blocked accumulation of second moments reads a cube."""
    return int(np.ceil(bands / block))
