"""Raw rasters: score maps, target maps, masks and annotations."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from ..model import TRUTH
from ..operators.evaluate import LAST_LABEL
from .placed import PlacedWriter, local_path

_TYPES = {"f32": ("<f4", "float"), "i32": ("<i4", "int"), "u8": ("u1", "short")}


#: Entries that a task reads, unless the option entries_per_partition says otherwise.
ENTRIES = 4 << 20
_BATCH = 1 << 18


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _RasterReader(DataSourceReader):
    """Ranges of one file, so that a file of any size is read in parallel."""

    def __init__(self, options):
        self.path, self.kind, self.pixels = local_path(options["path"]), options["kind"], int(options["pixels"])
        self.frame_index, self.step = int(options.get("frame_index", 0)), int(options.get("entries_per_partition", ENTRIES))

    def partitions(self):
        size = np.dtype(_TYPES[self.kind][0]).itemsize
        if os.path.getsize(self.path) != self.pixels * size:
            raise ValueError(f"{self.path} has {os.path.getsize(self.path) // size} entries, {self.pixels} are expected")
        return [_Range(k, min(k + self.step, self.pixels)) for k in range(0, self.pixels, self.step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(_TYPES[self.kind][0])
        with open(self.path, "rb") as f:
            f.seek(part.first * dtype.itemsize)
            for k in range(part.first, part.last, _BATCH):
                n = min(_BATCH, part.last - k)
                values = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                values = values.astype(np.int16) if self.kind == "u8" else values
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.frame_index, np.int64)), pa.array(np.arange(k, k + n)), pa.array(values)], names=["frame_index", "p", "value"])


class _RasterSink(PlacedWriter):
    def __init__(self, options):
        self.dtype = np.dtype(_TYPES[options["kind"]][0])
        pixels = int(options["pixels"])
        super().__init__(local_path(options["path"]), pixels * self.dtype.itemsize, pixels, "value")

    def values(self, column: pa.Array) -> np.ndarray:
        if column.null_count:
            raise ValueError("a pixel has no value")
        return column.to_numpy(zero_copy_only=False).astype(self.dtype)

    def place(self, f, p: int, values: np.ndarray) -> None:
        f.seek(p * self.dtype.itemsize)
        f.write(values.tobytes())


class RasterSource(DataSource):
    """spark.read.format("prismlake_raster") with options kind (f32, i32, u8), pixels, frame_index, entries_per_partition gives frame_index, p, value;
    df.write.format("prismlake_raster").mode("append") with kind and pixels writes p and value."""

    @classmethod
    def name(cls) -> str:
        return "prismlake_raster"

    def schema(self) -> str:
        return f"frame_index long, p long, value {_TYPES[self.options['kind']][1]}"

    def reader(self, schema) -> DataSourceReader:
        return _RasterReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _RasterSink(self.options)


def read_raster(spark: SparkSession, path: str, kind: str, pixels: int, frame_index: int = 0, entries_per_partition: int = ENTRIES) -> DataFrame:
    """frame_index, p, value of a raw raster, read by ranges; a file of another length is refused."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("prismlake_raster").options(kind=kind, pixels=pixels, frame_index=frame_index, entries_per_partition=entries_per_partition).load(path)


def read_annotations(spark: SparkSession, path: str, key: str = "gt") -> DataFrame:
    """scene, y, x, label from NumPy archives, by blocks of lines; the scene is the file's name without its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                gt = np.load(io.BytesIO(raw), allow_pickle=False)[key]
                scene, step = name.rsplit("/", 1)[-1].rsplit(".", 1)[0], max(1, _BATCH // max(1, gt.shape[1]))
                for first in range(0, len(gt), step):
                    part = gt[first : first + step]
                    y, x = np.divmod(np.arange(part.size), part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([scene] * part.size, pa.string()), pa.array((y + first).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(part.reshape(-1).astype(np.int16))], names=["scene", "y", "x", "label"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "scene string, y int, x int, label short")


def mask_value(label: Column) -> Column:
    """Labels as a mask stores them: those that are no materials become 255."""
    return F.when(label <= LAST_LABEL, label).otherwise(255).cast("short")


def truth_from_raster(raster: DataFrame) -> DataFrame:
    return raster.select("frame_index", "p", F.col("value").cast("short").alias("label")).to(TRUTH)


def write_raster(df: DataFrame, column: str, kind: str, path: str, pixels: int) -> None:
    """One frame's column as a raw raster in the order of p, written by tasks; the file appears whole or not at all."""
    df.sparkSession.dataSource.register(RasterSource)
    values = df.select("p", F.col(column).cast(_TYPES[kind][1]).alias("value")).repartitionByRange("p").sortWithinPartitions("p")
    values.write.format("prismlake_raster").mode("append").options(kind=kind, pixels=pixels).save(path)


def write_frame_csv(results: DataFrame, path: str) -> None:
    """Results of frames (frame_index, ms, detections_found) as CSV with a header."""
    results.write.mode("overwrite").csv(path, header=True)
