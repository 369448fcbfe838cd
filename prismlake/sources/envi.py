"""ENVI cubes: a text header beside a raw file, as a Spark data source and a sink.

A reader task takes a range of image lines of one file through a memory map and
yields Arrow batches of pixels, so a file of any size is read in parallel and
only the lines of a task are in memory.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StringType, StructType

from ..model import PIXELS, CubeShape, Interleave
from ..operators import layout
from .placed import PlacedWriter, local_path

# Fixed values of the format: sample types by code, and the endings of data files in the order they are tried.
SAMPLE_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}
DATA_ENDINGS = ("", ".float", ".dat", ".img", ".bin", ".raw", ".bsq", ".bil", ".bip", ".cube")
#: What integers are divided by; unsigned 32-bit ones by the signed limit too, so they can exceed 1.
FULL_SCALE = {"u1": 255.0, "i2": 32767.0, "i4": 2147483647.0, "u2": 65535.0, "u4": 2147483647.0}
BATCH_BYTES = 8 << 20
#: The ending of the file beside a cube that lacks pixels, a byte for each: 1 where there is one.
MARKS_ENDING = ".there"


@dataclass(frozen=True)
class Header:
    shape: CubeShape
    data_type: int
    interleave: Interleave
    header_offset: int = 0
    big_endian: bool = False
    wavelengths_nm: tuple[float, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        if self.data_type not in SAMPLE_TYPES:
            raise ValueError(f"ENVI data type {self.data_type} is not supported")
        return SAMPLE_TYPES[self.data_type]

    @property
    def sample_size(self) -> int:
        return int(self.kind[1])

    @property
    def dtype(self) -> np.dtype:
        return np.dtype((">" if self.big_endian else "<") + self.kind)


def _fields(text: str) -> dict[str, str]:
    """Keys in lower case; a value in braces may run over lines; ";" starts a comment line."""
    out: dict[str, str] = {}
    key, held = None, []
    for line in text.splitlines():
        if key is None:
            if line.lstrip().startswith(";") or "=" not in line:
                continue
            name, _, value = line.partition("=")
            name, value = name.strip().lower(), value.strip()
            if value.startswith("{") and "}" not in value:
                key, held = name, [value]
            else:
                out[name] = value
        elif not line.lstrip().startswith(";"):
            held.append(line)
            if "}" in line:
                out[key] = "\n".join(held).strip()
                key = None
    if key is not None:
        raise ValueError(f"the value of {key!r} has no closing brace")
    return out


def parse_header(text: str, source: str = "header") -> Header:
    if text.lstrip()[:4].upper() != "ENVI":
        raise ValueError(f"{source}: not an ENVI header")
    fields = _fields(text)

    def whole(name: str, default: int | None = None) -> int:
        if name not in fields:
            if default is None:
                raise ValueError(f"{source}: {name!r} is missing")
            return default
        try:
            return int(fields[name])
        except ValueError:
            raise ValueError(f"{source}: {name!r} is not a whole number: {fields[name]!r}") from None

    shape = CubeShape(whole("lines"), whole("samples"), whole("bands"))
    if not shape.valid:
        raise ValueError(f"{source}: lines, samples and bands must be positive")
    named = fields.get("interleave", "bsq").strip().lower()
    if named not in {i.value for i in Interleave}:
        raise ValueError(f"{source}: unknown interleave {named!r}")
    try:
        listed = fields.get("wavelength", "").strip().strip("{}").replace("\n", ",").replace("\r", ",").split(",")
        waves = tuple(float(w) for w in listed if w.strip())
    except ValueError:
        waves = ()
    header = Header(shape, whole("data type"), Interleave(named), whole("header offset", 0), whole("byte order", 0) == 1, waves, fields)
    header.kind  # noqa: B018  refuses unknown types
    return header


def read_header(path: str) -> Header:
    try:
        with open(path, encoding="latin-1") as f:
            return parse_header(f.read(), path)
    except OSError as e:
        raise ValueError(f"cannot open {path}") from e


def find_data_file(header_path: str) -> str:
    """The data file beside a header, "" if there is none."""
    stem = os.path.splitext(header_path)[0]
    return next((stem + e for e in DATA_ENDINGS if os.path.isfile(stem + e) and stem + e != header_path), "")


def scaled(raw: np.ndarray, kind: str) -> np.ndarray:
    out = raw.astype(np.float32)
    return (raw.astype(np.float64) / FULL_SCALE[kind]).astype(np.float32) if kind in FULL_SCALE else out


def _lines(path: str, data: str, header: Header, first: int, last: int) -> np.ndarray:
    """Lines [first, last) as (lines, width, bands) of 32-bit floats."""
    s = header.shape
    needed = header.header_offset + s.pixels * s.bands * header.sample_size
    if os.path.getsize(data) < needed:
        raise ValueError(f"{data}: {os.path.getsize(data)} bytes, {needed} needed by {path}")
    stored = {Interleave.BSQ: (s.bands, s.height, s.width), Interleave.BIL: (s.height, s.bands, s.width), Interleave.BIP: (s.height, s.width, s.bands)}[header.interleave]
    whole = np.memmap(data, dtype=header.dtype, mode="r", offset=header.header_offset, shape=stored)
    part = {Interleave.BSQ: lambda: whole[:, first:last].transpose(1, 2, 0), Interleave.BIL: lambda: whole[first:last].transpose(0, 2, 1), Interleave.BIP: lambda: whole[first:last]}[header.interleave]()
    return scaled(np.ascontiguousarray(part), header.kind)


def _marked(path: str, shape: CubeShape, first: int, last: int) -> np.ndarray | None:
    """Which pixels of lines [first, last) are there; None if all are."""
    marks = os.path.splitext(path)[0] + MARKS_ENDING
    if not os.path.exists(marks):
        return None
    if os.path.getsize(marks) != shape.pixels:
        raise ValueError(f"{marks}: {os.path.getsize(marks)} bytes, {shape.pixels} are expected")
    return np.fromfile(marks, "u1", (last - first) * shape.width, offset=first * shape.width) != 0


def read_cube(path: str) -> tuple[np.ndarray, Header]:
    """A whole cube as (height, width, bands), for small files; pixels that are missing are zero."""
    header = read_header(path)
    data = find_data_file(path)
    if not data:
        raise ValueError(f"no data file beside {path}")
    return _lines(path, data, header, 0, header.shape.height), header


def pixel_batch(frame_index: int, first_line: int, cube: np.ndarray) -> pa.RecordBatch:
    h, w, b = cube.shape
    y, x = np.divmod(np.arange(h * w), w)
    y = y + first_line
    values = pa.array(np.ascontiguousarray(cube, dtype=np.float32).reshape(-1))
    spectra = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w * b + 1, b, dtype=np.int32)), values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(h * w, frame_index, dtype=np.int64)), pa.array((y * w + x).astype(np.int64)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), spectra], names=[f.name for f in PIXELS.fields])


def header_paths(path: str) -> list[str]:
    """Headers of a file, a folder or a pattern, in order."""
    found = sorted(glob.glob(os.path.join(path, "*.hdr")) if os.path.isdir(path) else glob.glob(path))
    if not found:
        raise ValueError(f"cannot open {path}: no header there")
    return found


@dataclass
class _Lines(InputPartition):
    path: str
    frame_index: int
    first: int
    last: int


#: Comparisons that choose frames, scenes and lines, by the value of a frame, a scene or a pixel's line.
_COMPARED = {
    ds.EqualTo: lambda v, x: v == x, ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x, ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x, ds.StringStartsWith: lambda v, x: v.startswith(x), ds.StringEndsWith: lambda v, x: v.endswith(x), ds.StringContains: lambda v, x: x in v,
}


def scene_name(path: str) -> str:
    """A scene is named by its header's file without the ending."""
    return os.path.splitext(os.path.basename(path))[0]


class _Reader(DataSourceReader):
    """Plans from the first header and the names of the others; a task that reads a file checks that its shape is the same.

    Filters on frame_index, scene and y are met by the choice of files and lines,
    and those on p narrow the lines, so that nothing else is opened.
    """

    def __init__(self, options):
        paths = header_paths(local_path(options["path"]))
        most = int(options.get("max_resident", 0))
        self.paths = paths[:most] if most else paths
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.loops, self.lines = int(options.get("loops", 1)), int(options.get("lines_per_partition", 0))
        self.named = str(options.get("scene_column", "")).lower() == "true"
        self.shape = read_header(self.paths[0]).shape
        self.tests: dict[str, list] = {"frame_index": [], "scene": [], "y": [], "p": []}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, ds.IsNotNull) and column in self.tests:
                continue  # none of these is ever null
            if column in self.tests and type(f) in _COMPARED and f.value is not None:
                self.tests[column].append((type(f), f.value))
                if column == "p":
                    yield f
            else:
                yield f

    def _frame(self, k: int, path: str) -> bool:
        return all(_COMPARED[kind](k, v) for kind, v in self.tests["frame_index"]) and all(_COMPARED[kind](scene_name(path), v) for kind, v in self.tests["scene"])

    def _line(self, y: int) -> bool:
        first, last = y * self.shape.width, (y + 1) * self.shape.width - 1
        may = {ds.EqualTo: lambda v: first <= v <= last, ds.In: lambda v: any(first <= x <= last for x in v), ds.GreaterThan: lambda v: last > v, ds.GreaterThanOrEqual: lambda v: last >= v, ds.LessThan: lambda v: first < v, ds.LessThanOrEqual: lambda v: first <= v}
        return all(_COMPARED[kind](y, v) for kind, v in self.tests["y"]) and all(may[kind](v) for kind, v in self.tests["p"])

    def _ranges(self) -> list[tuple[int, int]]:
        """Runs of the lines asked for, in steps of a partition."""
        step = self.lines or max(1, (64 << 20) // (self.shape.width * self.shape.bands * 4))
        out: list[tuple[int, int]] = []
        for y in filter(self._line, range(self.shape.height)):
            if out and out[-1][1] == y and y % step:
                out[-1] = (out[-1][0], y + 1)
            else:
                out.append((y, y + 1))
        return out

    def partitions(self):
        ranges, n = self._ranges(), len(self.paths)
        return [_Lines(p, loop * n + k, a, b) for loop in range(self.loops) for k, p in enumerate(self.paths) if self._frame(loop * n + k, p) for a, b in ranges]

    def read(self, part: _Lines | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, _Lines):  # where there is nothing to read, Spark asks once, without a partition
            return
        header = read_header(part.path)
        if header.shape != self.shape:
            raise ValueError(f"{part.path}: {header.shape} differs from the first frame's {self.shape}")
        data = find_data_file(part.path)
        if not data:
            raise ValueError(f"no data file beside {part.path}")
        step = max(1, BATCH_BYTES // (header.shape.width * header.shape.bands * 4))
        for y in range(part.first, part.last, step):
            cube = _lines(part.path, data, header, y, min(y + step, part.last))
            batch = pixel_batch(part.frame_index, y, cube if self.bands is None else cube[:, :, self.bands])
            there = _marked(part.path, header.shape, y, min(y + step, part.last))
            batch = batch if there is None else batch.filter(pa.array(there))
            yield batch.append_column("scene", pa.array([scene_name(part.path)] * batch.num_rows, pa.string())) if self.named else batch


class _Replay(DataSourceStreamReader):
    """The frames of a path one after another, loops times; loops of 0 never end.

    By default a bounded stream offers all its frames at once, so a query that
    takes what is available ends by itself with all of them. With
    frames_per_batch, each batch gets so many; the offer moves on when a batch is
    planned, not when it is asked for. For a restart, the place is kept in the
    file that the option progress names.
    """

    def __init__(self, options):
        self.inner = _Reader(options)
        self.most = self.inner.loops * len(self.inner.paths)
        self.per_batch = int(options.get("frames_per_batch", 0 if self.most else 1))
        self.progress = local_path(options.get("progress", ""))
        self.planned = 0
        if self.progress and os.path.exists(self.progress):
            with open(self.progress, encoding="ascii") as f:
                self.planned = int(f.read() or 0)

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        if not self.per_batch:
            return {"frame": self.most}
        return {"frame": min(self.planned + self.per_batch, self.most) if self.most else self.planned + self.per_batch}

    def partitions(self, start: dict, end: dict):
        if end["frame"] > self.planned:
            self.planned = end["frame"]
            if self.progress:
                with open(self.progress + ".new", "w", encoding="ascii") as f:
                    f.write(str(self.planned))
                os.replace(self.progress + ".new", self.progress)
        n, ranges = len(self.inner.paths), self.inner._ranges()
        return [_Lines(self.inner.paths[k % n], k, a, b) for k in range(start["frame"], end["frame"]) for a, b in ranges]

    def read(self, part: _Lines) -> Iterator[pa.RecordBatch]:
        return self.inner.read(part)

    def commit(self, end: dict) -> None:
        pass


class _Sink(PlacedWriter):
    """One frame in any interleave and sample type; integers are the reader's values times their full scale, rounded half up."""

    def __init__(self, options):
        path = local_path(options["path"])
        self.stem = os.path.splitext(path)[0] if path.endswith(".hdr") else path
        self.header = Header(
            CubeShape(int(options["lines"]), int(options["samples"]), int(options["bands"])), int(options.get("data_type", 4)), Interleave(options.get("interleave", "bsq").lower()),
            int(options.get("header_offset", 0)), str(options.get("byte_order", "0")) == "1", tuple(float(w) for w in options.get("wavelengths", "").split(",") if w),
        )
        if not self.header.shape.valid:
            raise ValueError("lines, samples and bands must be positive")
        s = self.header.shape
        self.partial = str(options.get("partial", "")).lower() == "true"
        super().__init__(self.stem + options.get("ending", ".float"), self.header.header_offset + s.pixels * s.bands * self.header.sample_size, s.pixels, "spectrum", self.stem + MARKS_ENDING if self.partial else "")

    def values(self, column: pa.Array) -> np.ndarray:
        if column.null_count or column.flatten().null_count:
            raise ValueError("a pixel has no spectrum, or a band without a value")
        x = column.flatten().to_numpy(zero_copy_only=False)
        if len(x) != len(column) * self.header.shape.bands or (np.diff(column.offsets.to_numpy()) != self.header.shape.bands).any():
            raise ValueError(f"a pixel lies outside {self.header.shape}: it has other bands")
        kind = self.header.kind
        if kind in FULL_SCALE:
            x = np.floor(x.astype(np.float64) * FULL_SCALE[kind] + 0.5)
            limits = np.iinfo(kind)
            if not (np.isfinite(x).all() and limits.min <= x.min(initial=0) and x.max(initial=0) <= limits.max):
                raise ValueError(f"a value doesn't fit into type {self.header.data_type}")
        return x.astype(kind).reshape(len(column), -1)

    def place(self, f, p: int, values: np.ndarray) -> None:
        s, size = self.header.shape, self.header.sample_size
        values = values.astype(self.header.dtype)  # arrays that were joined have the machine's byte order
        at = lambda y, x, band: self.header.header_offset + size * int(layout.offset(self.header.interleave, s, y, x, band))
        if self.header.interleave is Interleave.BIP:
            f.seek(at(*divmod(p, s.width), 0))
            f.write(values.tobytes())
            return
        # A piece is a whole run for bands one after another, and the part of a line for bands within lines.
        pieces = [(p, values)] if self.header.interleave is Interleave.BSQ else []
        if not pieces:
            cuts = [0, *range(s.width - p % s.width, len(values), s.width), len(values)]
            pieces = [(p + a, values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for first, part in pieces:
            y, x = divmod(first, s.width)
            for band in range(s.bands):
                f.seek(at(y, x, band))
                f.write(part[:, band].tobytes())

    def finish(self) -> None:
        """Whoever finds the header finds its data: the old header goes first, the new one comes last."""
        path = self.stem + ".hdr"
        for old in (path, self.stem + MARKS_ENDING):
            if os.path.exists(old):
                os.unlink(old)
        super().finish()
        with open(self.staging + ".hdr", "w", encoding="ascii") as f:
            f.write(header_text(self.header))
        os.replace(self.staging + ".hdr", path)


class EnviSource(DataSource):
    """spark.read or readStream.format("prismlake_envi").load(path): options bands, max_resident (the first so many frames), loops, lines_per_partition,
    scene_column (true: the scene's name as a column), frames_per_batch, progress.

    df.write.format("prismlake_envi").mode("append").save(stem) writes one frame (p, spectrum): options lines, samples, bands, data_type, interleave,
    byte_order, header_offset, wavelengths (by commas), ending, partial (true: pixels may be missing; they are no rows when the cube is read).
    """

    @classmethod
    def name(cls) -> str:
        return "prismlake_envi"

    def schema(self) -> StructType:
        return StructType([*PIXELS.fields]).add("scene", StringType()) if str(self.options.get("scene_column", "")).lower() == "true" else PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Replay(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Sink(self.options)


CATALOGUE = "path string, scene string, lines int, samples int, bands int, data_type int, interleave string, header_offset int, big_endian boolean, wavelengths_nm array<float>, fields map<string,string>"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each header of a folder or pattern, with all its fields as a map; headers are read by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                h = parse_header(raw.decode("latin-1"), name)
                rows.append({"path": local_path(name), "scene": scene_name(name), "lines": h.shape.height, "samples": h.shape.width, "bands": h.shape.bands, "data_type": h.data_type, "interleave": h.interleave.value,
                             "header_offset": h.header_offset, "big_endian": h.big_endian, "wavelengths_nm": list(h.wavelengths_nm) or None, "fields": list(h.fields.items())})
            kinds = {"lines": pa.int32(), "samples": pa.int32(), "bands": pa.int32(), "data_type": pa.int32(), "header_offset": pa.int32(), "big_endian": pa.bool_(), "wavelengths_nm": pa.list_(pa.float32()), "fields": pa.map_(pa.string(), pa.string())}
            names = [part.split(" ")[0] for part in CATALOGUE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    found = path if not os.path.isdir(local_path(path)) else os.path.join(path, "*.hdr")
    return spark.read.format("binaryFile").load(found).select("path", "content").mapInArrow(run, CATALOGUE)


def frames(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """One row for each header of a path, in the order of names."""
    order = spark.createDataFrame([(k, p) for k, p in enumerate(header_paths(local_path(path)))], "frame_index long, path string")
    rows = catalogue(spark, path).select(F.regexp_replace("path", "^/+", "/").alias("path"), *[c for c in ("lines", "samples", "bands", "wavelengths_nm")])
    return order.join(rows, "path").select("frame_index", (F.col("frame_index") / fps).alias("timestamp_s"), F.col("path").alias("source"), F.col("lines").alias("height"), F.col("samples").alias("width"), "bands", "wavelengths_nm").orderBy("frame_index")


def header_text(header: Header) -> str:
    s = header.shape
    lines = ["ENVI", f"samples = {s.width}", f"lines = {s.height}", f"bands = {s.bands}", f"header offset = {header.header_offset}", "file type = ENVI Standard", f"data type = {header.data_type}", f"interleave = {header.interleave.value}", f"byte order = {int(header.big_endian)}"]
    if len(header.wavelengths_nm):
        lines += ["wavelength units = nm", "wavelength = { " + ", ".join(repr(float(w)) for w in header.wavelengths_nm) + " }"]
    return "\n".join(lines) + "\n"


def format_header(shape: CubeShape, wavelengths_nm: tuple[float, ...] = ()) -> str:
    return header_text(Header(shape, 4, Interleave.BSQ, wavelengths_nm=tuple(wavelengths_nm)))


def write_cube(
    stem: str, pixels: DataFrame, shape: CubeShape, wavelengths_nm: tuple[float, ...] = (), frame_index: int = 0, data_type: int = 4, interleave: str = "bsq", big_endian: bool = False, header_offset: int = 0,
    partial: bool = False,
) -> str:
    """Write one frame as a cube; the path of its header. The cube appears whole or not at all; every pixel must be there, unless it is partial.

    Pixels are dealt into ranges of places first, so a task's are together in the file.
    """
    register(pixels.sparkSession)
    one = pixels.where(F.col("frame_index") == frame_index).select("p", "spectrum").repartitionByRange("p").sortWithinPartitions("p")
    options = {"lines": shape.height, "samples": shape.width, "bands": shape.bands, "data_type": data_type, "interleave": interleave, "byte_order": int(big_endian), "header_offset": header_offset, "partial": str(partial).lower(), "wavelengths": ",".join(repr(float(w)) for w in wavelengths_nm)}
    one.write.format("prismlake_envi").mode("append").options(**options).save(stem)
    return stem + ".hdr"


def register(spark: SparkSession) -> None:
    """The source and sink, and Spark's setting that hands filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnviSource)
