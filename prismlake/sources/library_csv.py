"""Spectral libraries as CSV: a name and its values on each line, "#" comments, an optional row of wavelengths."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.library import Library

_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|nan)", re.IGNORECASE)
_WAVELENGTH_NAMES = ("wavelength", "wavelengths", "wavelength_nm")


def parse_library(text: str, source: str = "library") -> Library:
    """Errors name the source and, for a bad field, its line. What follows a number makes it no number."""
    names, rows, waves = [], [], None
    for number, line in enumerate(text.splitlines(), start=1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        fields = [f.strip() for f in line.split(",")]
        if not fields[-1]:
            fields.pop()
        if len(fields) < 2:
            raise ValueError(f"{source}, line {number}: a name and at least one value are needed")
        values = []
        for f in fields[1:]:
            if not _NUMBER.fullmatch(f):
                raise ValueError(f"{source}, line {number}: {f!r} is not a number")
            values.append(float(f))
        if fields[0].lower() in _WAVELENGTH_NAMES:
            waves = tuple(values)
        else:
            names.append(fields[0])
            rows.append(values)
    if not rows:
        raise ValueError(f"{source}: no target spectra")
    for name, values in zip(names, rows, strict=True):
        if len(values) != len(rows[0]):
            raise ValueError(f"{source}: {name} has {len(values)} bands, {names[0]} has {len(rows[0])}")
    if waves is not None and len(waves) != len(rows[0]):
        raise ValueError(f"{source}: the wavelength row has {len(waves)} values, the targets have {len(rows[0])}")
    return Library(tuple(names), np.array(rows, dtype=np.float32), waves)


def read_library(spark: SparkSession, path: str) -> Library:
    """Through Spark, so from any store that Spark reads."""
    try:
        rows = spark.read.text(path, wholetext=True).take(2)
    except Exception as e:
        raise ValueError(f"cannot open {path}") from e
    if len(rows) != 1:
        raise ValueError(f"cannot open {path}: one file is needed")
    return parse_library(rows[0]["value"], path)


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """One library file as a table in the order of its lines."""
    return read_library(spark, path).frame(spark)


def format_library(library: Library) -> str:
    """Text that reads back to the same 32-bit values."""
    shortest = lambda v: repr(float(np.format_float_positional(np.float32(v), unique=True, trim="0")))
    lines = []
    if library.wavelengths_nm is not None:
        lines.append(",".join(["wavelength", *(repr(float(w)) for w in library.wavelengths_nm)]))
    lines += [",".join([n, *map(shortest, x)]) for n, x in zip(library.names, library.values, strict=True)]
    return "\n".join(lines) + "\n"


def write_library(library: Library, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(format_library(library))
