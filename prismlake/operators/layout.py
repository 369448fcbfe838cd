"""Layouts of cubes and their reshaping, on arrays and on pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CubeShape, Interleave

#: Axes of (height, width, bands) in storage order.
_AXES = {Interleave.BSQ: (2, 0, 1), Interleave.BIL: (0, 2, 1), Interleave.BIP: (0, 1, 2)}


def offset(layout: Interleave | str, shape: CubeShape, y, x, band):
    """Where an element lies, for numbers, arrays or columns alike."""
    layout = Interleave(layout)
    if layout is Interleave.BSQ:
        return band * (shape.height * shape.width) + y * shape.width + x
    if layout is Interleave.BIL:
        return (y * shape.bands + band) * shape.width + x
    return (y * shape.width + x) * shape.bands + band


def to_bip(flat: np.ndarray, shape: CubeShape, layout: Interleave | str) -> np.ndarray:
    """A cube of (height, width, bands) from its elements in storage order."""
    axes = _AXES[Interleave(layout)]
    sizes = (shape.height, shape.width, shape.bands)
    return flat.reshape([sizes[a] for a in axes]).transpose(np.argsort(axes))


def from_bip(cube: np.ndarray, layout: Interleave | str) -> np.ndarray:
    """The elements of a (height, width, bands) cube in storage order."""
    return np.ascontiguousarray(cube.transpose(_AXES[Interleave(layout)])).reshape(-1)


def convert_interleave(flat: np.ndarray, shape: CubeShape, source: Interleave | str, target: Interleave | str) -> np.ndarray:
    if flat.size != shape.pixels * shape.bands:
        raise ValueError(f"{flat.size} elements do not fill {shape}")
    return from_bip(to_bip(flat, shape, source), target)


def elements(pixels: DataFrame, shape: CubeShape, layout: Interleave | str) -> DataFrame:
    """The long form of a pixel table: frame_index, position in the layout, value."""
    long = pixels.select("frame_index", "y", "x", F.posexplode("spectrum").alias("band", "value"))
    return long.select("frame_index", offset(layout, shape, F.col("y").cast("long"), F.col("x"), F.col("band")).cast("long").alias("position"), F.col("value").cast("double").alias("value"))


def _place(layout: Interleave, shape: CubeShape, position: Column) -> tuple[Column, Column, Column]:
    if layout is Interleave.BSQ:
        return F.floor(position / shape.pixels), F.floor((position % shape.pixels) / shape.width), position % shape.width
    if layout is Interleave.BIL:
        line = F.floor(position / shape.width)
        return line % shape.bands, F.floor(line / shape.bands), position % shape.width
    p = F.floor(position / shape.bands)
    return position % shape.bands, F.floor(p / shape.width), p % shape.width


def from_elements(long: DataFrame, shape: CubeShape, layout: Interleave | str) -> DataFrame:
    """A pixel table from the long form; one shuffle, by pixel."""
    band, y, x = _place(Interleave(layout), shape, F.col("position"))
    placed = long.select("frame_index", y.cast("int").alias("y"), x.cast("int").alias("x"), F.struct(band.cast("int").alias("band"), F.col("value").cast("float").alias("v")).alias("e"))
    whole = placed.groupBy("frame_index", "y", "x").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return whole.select("frame_index", (F.col("y").cast("long") * shape.width + F.col("x")).alias("p"), "y", "x", F.transform("e", lambda e: e["v"]).alias("spectrum"))


STRIPS = "frame_index long, start long, data binary"
#: Bytes of a block of whole lines, the unit that is transposed at once; a longer line is a block by itself.
BLOCK_BYTES = 4 << 20


def block_lines(shape: CubeShape) -> int:
    """Lines of a block."""
    return max(1, min(shape.height, BLOCK_BYTES // (shape.width * shape.bands * 4)))


def _block(shape: CubeShape, first: int, lines: int) -> CubeShape:
    return CubeShape(min(lines, shape.height - first), shape.width, shape.bands)


def _runs(shape: CubeShape, layout: Interleave, first: int, lines: int) -> list[tuple[int, int]]:
    """Where the elements of a block lie in storage order: (start, length) of each run."""
    part = _block(shape, first, lines)
    if layout is Interleave.BSQ:
        return [(band * shape.pixels + first * shape.width, part.pixels) for band in range(shape.bands)]
    return [(first * shape.width * shape.bands, part.pixels * shape.bands)]


def _strips_of(frame: int, cube: np.ndarray, shape: CubeShape, layout: Interleave, first: int, lines: int) -> pa.Table:
    """A block of (lines, width, bands) as rows of STRIPS."""
    flat, at, rows = from_bip(cube.astype("<f4"), layout), 0, []
    for start, length in _runs(shape, layout, first, lines):
        rows.append((frame, start, flat[at : at + length].tobytes()))
        at += length
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("frame_index", "start", "data"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)})


def strips(pixels: DataFrame, shape: CubeShape, layout: Interleave | str, lines: int | None = None, partial: bool = False) -> DataFrame:
    """A pixel table as runs of storage order in 32 bits, little-endian: frame_index, start (position of the first element), data.

    Pixels are shuffled once, by blocks of whole lines, and a block is transposed
    in one piece. Every pixel must be there exactly once; null values are NaN.
    With partial, pixels may be missing: all their bands are NaN where the block
    has others, and which pixels there are is for the pixel table to say.
    """
    layout, lines = Interleave(layout), lines or block_lines(shape)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        frame, number = (k.as_py() for k in key)
        first = number * lines
        part = _block(shape, first, lines)
        at = rows.column("p").to_numpy() - first * shape.width
        often = np.bincount(at, minlength=part.pixels)
        if (often > 1).any() or not (partial or often.all()):
            raise ValueError(f"frame {frame}: lines {first} to {first + part.height - 1} need each pixel once")
        spectra = rows.column("spectrum").combine_chunks()
        if spectra.null_count or set(pc.unique(pc.list_value_length(spectra)).to_pylist()) != {shape.bands}:
            raise ValueError(f"frame {frame}: a spectrum doesn't have {shape.bands} bands")
        cube = np.full((part.pixels, shape.bands), np.nan, "<f4")
        cube[at] = spectra.flatten().to_numpy(zero_copy_only=False).reshape(len(at), shape.bands)
        return _strips_of(frame, cube.reshape(part.height, shape.width, shape.bands), shape, layout, first, lines)

    inside = F.when((F.col("p") >= 0) & (F.col("p") < shape.pixels), F.col("p")).otherwise(F.raise_error(F.lit(f"pixels outside of {shape}")).cast("long"))
    keyed = pixels.select("frame_index", inside.alias("p"), F.col("spectrum").cast("array<float>").alias("spectrum"), F.floor(inside / (shape.width * lines)).alias("block"))
    return keyed.groupBy("frame_index", "block").applyInArrow(build, STRIPS)


def _cut(found: DataFrame, shape: CubeShape, layout: Interleave, lines: int) -> DataFrame:
    """Strips of any length cut where blocks end, with the number of the block: what is shuffled is the cube's bytes, in long rows."""
    size = lines * shape.width * (1 if layout is Interleave.BSQ else shape.bands)
    whole, within = shape.pixels * shape.bands, shape.pixels if layout is Interleave.BSQ else shape.pixels * shape.bands

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = memoryview(data.as_buffer())
                if len(data) % 4 or start < 0 or start + len(data) // 4 > whole:
                    raise ValueError(f"frame {frame}: a strip at {start} of {len(data)} bytes isn't within {shape}")
                rows, end = [], start + len(data) // 4
                at = start
                while at < end:
                    run, place = divmod(at, within)
                    number = place // size
                    stop = min(end, run * within + min((number + 1) * size, within))
                    rows.append((frame, at, bytes(data[(at - start) * 4 : (stop - start) * 4]), number))
                    at = stop
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["frame_index", "start", "data", "block"])

    return found.select("frame_index", "start", "data").mapInArrow(cut, f"{STRIPS}, block long")


def _gather(rows: pa.Table, frame: int, shape: CubeShape, layout: Interleave, first: int, lines: int) -> np.ndarray:
    """The block of (lines, width, bands) that its strips fill; each element must be there exactly once."""
    runs = _runs(shape, layout, first, lines)
    part, starts = _block(shape, first, lines), np.array([s for s, _ in runs])
    flat, filled = np.empty(part.pixels * shape.bands, "<f4"), 0
    ends = []
    for start, data in zip(rows.column("start").to_pylist(), rows.column("data"), strict=True):
        values = np.frombuffer(data.as_buffer(), "<f4")
        run = int(np.searchsorted(starts, start, "right")) - 1
        at = run * runs[0][1] + start - runs[run][0]
        flat[at : at + len(values)] = values
        filled += len(values)
        ends.append((at, at + len(values)))
    ends.sort()
    if filled != len(flat) or any(a[1] != b[0] for a, b in zip(ends, ends[1:], strict=False)):
        raise ValueError(f"frame {frame}: strips don't fill lines {first} to {first + part.height - 1} exactly once")
    return to_bip(flat, part, layout)


def convert_strips(found: DataFrame, shape: CubeShape, source: Interleave | str, target: Interleave | str, lines: int | None = None) -> DataFrame:
    """Strips of one interleave from those of another, out of core: one shuffle of the cube's bytes, a block in memory at a time.

    Strips may have any length and order, and must fill a block of lines exactly once; a block without any gives none.
    """
    source, target, lines = Interleave(source), Interleave(target), lines or block_lines(shape)

    def turn(key: tuple, rows: pa.Table) -> pa.Table:
        frame, number = (k.as_py() for k in key)
        return _strips_of(frame, _gather(rows, frame, shape, source, number * lines, lines), shape, target, number * lines, lines)

    return _cut(found, shape, source, lines).groupBy("frame_index", "block").applyInArrow(turn, STRIPS)


def from_strips(found: DataFrame, shape: CubeShape, layout: Interleave | str, lines: int | None = None) -> DataFrame:
    """A pixel table from strips; one shuffle of the cube's bytes."""
    layout, lines = Interleave(layout), lines or block_lines(shape)

    def unfold(key: tuple, rows: pa.Table) -> pa.Table:
        frame, number = (k.as_py() for k in key)
        first = number * lines
        cube = _gather(rows, frame, shape, layout, first, lines).reshape(-1, shape.bands)
        p = first * shape.width + np.arange(len(cube))
        spectra = pa.ListArray.from_arrays(pa.array(np.arange(len(cube) + 1, dtype=np.int32) * shape.bands), pa.array(np.ascontiguousarray(cube).reshape(-1)))
        return pa.table({"frame_index": pa.array(np.full(len(cube), frame)), "p": pa.array(p), "y": pa.array((p // shape.width).astype(np.int32)), "x": pa.array((p % shape.width).astype(np.int32)), "spectrum": spectra})

    return _cut(found, shape, layout, lines).groupBy("frame_index", "block").applyInArrow(unfold, "frame_index long, p long, y int, x int, spectrum array<float>")


def demosaic(raw: np.ndarray, period: int, bands: int, order: list[int] | None = None) -> np.ndarray:
    """A (height, width, bands) cube from a mosaic image; a remainder at the right and bottom is left out.

    Within a tile of period x period, band b is the b-th sensor in row order, or
    the order[b]-th where an order is given.
    """
    if period <= 0 or not 0 < bands <= period * period:
        raise ValueError(f"a tile of {period} x {period} can't hold {bands} bands")
    order = list(range(bands)) if order is None else list(order)
    if len(order) != bands or any(not 0 <= o < period * period for o in order):
        raise ValueError("the band order needs one sensor of the tile for each band")
    h, w = raw.shape[0] // period, raw.shape[1] // period
    if not h or not w:
        raise ValueError("the image is smaller than one tile")
    tiles = raw[: h * period, : w * period].reshape(h, period, w, period).transpose(0, 2, 1, 3).reshape(h, w, period * period)
    return np.ascontiguousarray(tiles[:, :, order])


def demosaic_samples(samples: DataFrame, period: int, bands: int, width: int, height: int) -> DataFrame:
    """A pixel table from rows (frame_index, x, y, value) of a mosaic image."""
    inside = samples.where((F.col("x") < width // period * period) & (F.col("y") < height // period * period))
    sensor = (F.col("y") % period) * period + F.col("x") % period
    tiles = inside.where(sensor < bands).groupBy("frame_index", F.floor(F.col("y") / period).cast("int").alias("y"), F.floor(F.col("x") / period).cast("int").alias("x")).agg(F.sort_array(F.collect_list(F.struct(sensor.cast("int").alias("b"), F.col("value").cast("float").alias("v")))).alias("e"))
    return tiles.select("frame_index", (F.col("y").cast("long") * (width // period) + F.col("x")).alias("p"), "y", "x", F.transform("e", lambda e: e["v"]).alias("spectrum"))


def select_bands(df: DataFrame, keep: list[int], column: str = "spectrum") -> DataFrame:
    """Keep some bands, in the order given."""
    if any(b < 0 for b in keep):
        raise ValueError("band numbers start at 0")
    return df.withColumn(column, F.transform(F.array(*[F.lit(b) for b in keep]), lambda b: F.get(column, b)))


def drop_rows(df: DataFrame, rows: list[int], width: int) -> DataFrame:
    """Remove image rows; later ones move up."""
    gone = sorted(set(rows))
    moved = sum((F.col("y") > r).cast("int") for r in gone) if gone else F.lit(0)
    return df.where(~F.col("y").isin(gone)).withColumn("y", (F.col("y") - moved).cast("int")).withColumn("p", F.col("y").cast("long") * width + F.col("x"))


def quantize_half(df: DataFrame, column: str = "spectrum") -> DataFrame:
    """Values rounded to 16-bit floats and back, all of an Arrow batch at once; null spectra and null values stay null."""
    at = df.columns.index(column)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spectra = b.column(at)
            flat = spectra.flatten()
            with np.errstate(over="ignore"):
                values = flat.to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float16).astype(np.float32)
            rounded = pa.array(values, mask=flat.is_null().to_numpy(zero_copy_only=False)).cast(spectra.type.value_type)
            sizes = pc.fill_null(pc.list_value_length(spectra), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            new = pa.ListArray.from_arrays(ends, rounded, type=spectra.type, mask=spectra.is_null() if spectra.null_count else None)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(narrow, df.schema)
