"""Spectral libraries: small ordered tables of target spectra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..model import LIBRARY

#: A library is collected and sent to every task; more targets are refused.
MOST_TARGETS = 4096


@dataclass(frozen=True)
class Library:
    """Targets in order: a target's id is its place, and ties go to the lower id."""

    names: tuple[str, ...]
    values: np.ndarray
    wavelengths_nm: tuple[float, ...] | None = None

    def __post_init__(self):
        if len(self.names) != len(self.values):
            raise ValueError("a library needs as many names as spectra")

    @property
    def bands(self) -> int:
        return self.values.shape[1] if self.values.ndim == 2 else 0

    def norms(self) -> np.ndarray:
        """Norms added up in double precision."""
        return np.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1)) if len(self.values) else np.zeros(0)

    def flatten(self) -> np.ndarray:
        """All values, target after target."""
        return self.values.astype(np.float32).reshape(-1)

    def only(self, name: str) -> Library:
        """The targets of one name, numbered anew from 0."""
        at = [i for i, n in enumerate(self.names) if n == name]
        if not at:
            raise ValueError(f"no target named {name!r}; the library has: {', '.join(dict.fromkeys(self.names)) or 'none'}")
        return Library(tuple(self.names[i] for i in at), self.values[at], self.wavelengths_nm)

    def require_bands(self, bands: int) -> None:
        if len(self.names) and self.bands != bands:
            raise ValueError(f"the library has {self.bands} bands, the pixels have {bands}")

    def frame(self, spark: SparkSession) -> DataFrame:
        waves = list(self.wavelengths_nm) if self.wavelengths_nm is not None else None
        return spark.createDataFrame([(i, n, [float(v) for v in x], waves) for i, (n, x) in enumerate(zip(self.names, self.values, strict=True))], LIBRARY)

    def literal(self) -> Column:
        """The library as a constant array of (id, values, norm), for expressions."""
        rows = [F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(v)) for v in x]).alias("values"), F.lit(float(n)).alias("norm")) for i, (x, n) in enumerate(zip(self.values.astype(np.float64), self.norms(), strict=True))]
        return F.array(*rows)


def collect_library(df: DataFrame) -> Library:
    """A library from a DataFrame with target_id, name, values, and wavelengths_nm if known; ragged spectra are refused."""
    rows = df.orderBy("target_id").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"a library holds at most {MOST_TARGETS} targets")
    sizes = {len(r["values"]) for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"targets differ in their number of bands: {sorted(sizes)}")
    waves = rows[0]["wavelengths_nm"] if rows and "wavelengths_nm" in rows[0] else None
    values = np.array([r["values"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return Library(tuple(r["name"] for r in rows), values, tuple(waves) if waves else None)


def norms(library: DataFrame) -> DataFrame:
    return library.select("target_id", "name", spectral.norm(F.col("values")).alias("norm"))


def flatten(library: DataFrame) -> DataFrame:
    """One row for each value, numbered target after target."""
    bands = F.size("values")
    return library.select("target_id", F.posexplode("values").alias("band", "value"), bands.alias("bands")).select((F.col("target_id") * F.col("bands") + F.col("band")).cast("long").alias("position"), "target_id", "band", F.col("value").cast("double").alias("value"))
