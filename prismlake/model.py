"""Shapes, parameters, schemas and the registry of detectors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Interleave(str, Enum):
    BSQ = "bsq"
    BIL = "bil"
    BIP = "bip"


class Polarity(str, Enum):
    LOWER = "lower"
    HIGHER = "higher"


@dataclass(frozen=True)
class CubeShape:
    height: int
    width: int
    bands: int

    @property
    def valid(self) -> bool:
        return min(self.height, self.width, self.bands) > 0

    @property
    def pixels(self) -> int:
        return self.height * self.width


@dataclass(frozen=True)
class DetectionParams:
    """Thresholds are inclusive; nms_radius 0 or less keeps every pixel that passes; cap None keeps all detections."""

    threshold: float = 0.10
    nms_radius: int = 2
    max_detections: int | None = 4096
    polarity: Polarity = Polarity.LOWER


@dataclass(frozen=True)
class DetectorTraits:
    name: str
    needs_targets: bool
    needs_statistics: bool
    polarity: Polarity
    compute_bound: bool


DETECTORS = {
    t.name: t
    for t in (
        DetectorTraits("sam", True, False, Polarity.LOWER, False),
        DetectorTraits("rx", False, True, Polarity.HIGHER, True),
        DetectorTraits("ace", True, True, Polarity.HIGHER, True),
        DetectorTraits("cem", True, True, Polarity.HIGHER, False),
    )
}

#: How scores are computed: DataFrame expressions, NumPy over Arrow batches, or by the number of bands.
STRATEGIES = {"sql": "sql", "expression": "sql", "arrow": "arrow", "numpy": "arrow", "auto": "auto"}


def detector(name: str) -> DetectorTraits:
    found = DETECTORS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown detector {name!r}; known: {', '.join(DETECTORS)}")
    return found


def strategy(name: str) -> str:
    found = STRATEGIES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
    return found


PIXELS = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("p", T.LongType()), T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()), T.StructField("spectrum", T.ArrayType(T.FloatType())),
])
LIBRARY = T.StructType([
    T.StructField("target_id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("wavelengths_nm", T.ArrayType(T.FloatType())),
])
FRAMES = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("timestamp_s", T.DoubleType()), T.StructField("source", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("bands", T.IntegerType()),
    T.StructField("wavelengths_nm", T.ArrayType(T.FloatType())),
])
TRUTH = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("p", T.LongType()), T.StructField("label", T.ShortType())])
