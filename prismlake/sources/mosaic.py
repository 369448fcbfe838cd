"""Video of mosaic images: a folder of PNG frames, each demosaiced into a cube."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PIXELS
from ..operators.layout import demosaic
from . import png
from .envi import pixel_batch
from .placed import local_path

#: Bytes of frames' names that are broadcast at most; of more, images are shuffled to their numbers.
MOST_NAMES = 32 << 20
_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _decode(period: int, bands: int, order: list[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path, raw, first in zip(*(b[c].to_pylist() for c in ("frame_index", "path", "content", "first")), strict=True):
                if first and png.size(raw, path) != png.size(first, "the first frame"):
                    raise ValueError(f"{path}: {png.size(raw, path)} differs from the first frame's {png.size(first, 'the first frame')}")
                cube = demosaic(png.decode(raw, path), period, bands, order)
                yield pixel_batch(k, 0, cube)

    return run


def write_mosaic(samples: DataFrame, folder: str, width: int, height: int) -> int:
    """Write 16-bit frames from rows (frame_index, x, y, value); each frame is a file of its own, made by a task. How many there are.

    Places without a row are 0; rows outside of width x height are left out, and of several for a place the largest value is taken.
    """
    folder = local_path(folder)

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["frame_index"].iloc[0])
        image = np.zeros((height, width), np.uint16)
        image[frame["y"].to_numpy(), frame["x"].to_numpy()] = frame["value"].to_numpy()
        path = os.path.join(folder, f"frame{k:09d}.png")
        with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(png.encode(image))
        os.replace(f.name, path)
        return pd.DataFrame({"n": [1]})

    inside = samples.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    one = inside.groupBy("frame_index", "x", "y").agg(F.max("value").alias("value"))
    return one.groupBy("frame_index").applyInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def frame_table(spark: SparkSession, folder: str, fps: float = 25.0) -> DataFrame:
    """frame_index, timestamp_s, path of each frame in the order of names. The driver lists the folder, as for any read."""
    files = sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").load(folder).inputFiles())
    return spark.createDataFrame([(k, k / fps, p) for k, p in enumerate(files)], "frame_index long, timestamp_s double, path string")


def read_mosaic(spark: SparkSession, folder: str, period: int, bands: int, order: list[int] | None = None) -> DataFrame:
    """The pixels of all frames; every frame must have the first one's size. A folder without frames gives no rows.

    Images stay where they are read: the frames' numbers are broadcast to them, up to MOST_NAMES bytes of names.
    """
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").load(folder)
    files = sorted(images.inputFiles())
    if not files:
        return spark.createDataFrame([], PIXELS)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  listings differ in the slashes of file:
    numbered = spark.createDataFrame(list(enumerate(files)), "frame_index long, name string").select("frame_index", plain("name").alias("key"))
    if sum(map(len, files)) <= MOST_NAMES:
        numbered = F.broadcast(numbered)
    # The start of the first image: enough to read its size, and no more goes with each frame.
    first = spark.read.format("binaryFile").load(files[0]).select(F.substring("content", 1, 64)).first()[0]
    joined = images.select(plain("path").alias("key"), "path", "content").join(numbered, "key")
    return joined.select("frame_index", "path", "content", F.lit(bytes(first)).alias("first")).mapInArrow(_decode(period, bands, order), PIXELS)


def stream_mosaic(spark: SparkSession, folder: str, period: int, bands: int, order: list[int] | None = None, frames_per_trigger: int = 1) -> DataFrame:
    """Pixels of frames as they arrive. A frame's index is the number in its name; a file without one is refused."""
    images = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.[pP][nN][gG]").option("maxFilesPerTrigger", frames_per_trigger).load(folder)
    found = F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).try_cast("long")
    number = F.coalesce(found, F.raise_error(F.concat(F.lit("a frame's name needs a number: "), "path")).cast("long"))
    return images.select(number.alias("frame_index"), "path", "content", F.lit(None).cast("binary").alias("first")).mapInArrow(_decode(period, bands, order), PIXELS)
