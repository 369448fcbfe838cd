"""Scene statistics: moments that add up, what follows from them, and mean spectra."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from .library import MOST_TARGETS, Library

#: Partial moments are merged in so many tasks before the driver adds them up.
MERGE_TASKS = 32


@dataclass(frozen=True)
class Moments:
    """Count, mean and sums of products of differences from the mean, in double precision.

    Partial ones merge by the difference of their means, so no large sums are
    subtracted from one another and data far from zero keep their digits.
    """

    n: float
    centre: np.ndarray
    products: np.ndarray

    @staticmethod
    def none(bands: int) -> Moments:
        return Moments(0.0, np.zeros(bands), np.zeros((bands, bands)))

    @staticmethod
    def of(x: np.ndarray, reference: np.ndarray | None = None) -> Moments:
        x = np.asarray(x, dtype=np.float64)
        x = x if reference is None else x - reference
        if not len(x):
            return Moments.none(x.shape[1])
        centre = x.mean(axis=0)
        d = x - centre
        return Moments(float(len(x)), centre, d.T @ d)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return other if other.n else self
        apart = other.centre - self.centre
        return Moments(n, self.centre + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def unshifted(self, reference: np.ndarray) -> Moments:
        """The moments of x from those of x - reference."""
        return Moments(self.n, self.centre + reference, self.products)

    @property
    def s(self) -> np.ndarray:
        """Sums of bands."""
        return self.n * self.centre

    @property
    def o(self) -> np.ndarray:
        """Sums of products of bands."""
        return self.products + self.n * np.outer(self.centre, self.centre)

    def mean(self) -> np.ndarray:
        self._some()
        return self.centre

    def correlation(self, loading: float = 0.0) -> np.ndarray:
        self._some()
        return self.products / self.n + np.outer(self.centre, self.centre) + loading * np.eye(len(self.centre))

    def covariance(self, loading: float = 0.0) -> np.ndarray:
        """Of the population: divided by the count."""
        self._some()
        return self.products / self.n + loading * np.eye(len(self.centre))

    def _some(self) -> None:
        if self.n <= 0:
            raise ValueError("no pixels to take statistics from")


@dataclass(frozen=True)
class Statistics:
    """What the second-order detectors need of a scene and a library."""

    mean: np.ndarray
    whitener: np.ndarray
    target_white: np.ndarray
    target_norm2: np.ndarray
    cem_weight: np.ndarray


def build_statistics(moments: Moments, library: Library | None = None, loading: float = 0.0, narrow: bool = False) -> Statistics:
    """Whitener from the covariance, filters from the correlation, both with the same loading.

    A library of other bands is refused; so is a matrix that isn't positive
    definite, with a hint at the loading. narrow rounds the results to 32 bits.
    """
    bands = len(moments.centre)
    targets = np.zeros((0, bands))
    if library is not None and len(library.names):
        library.require_bands(bands)
        targets = library.values.astype(np.float64)
    mean = moments.mean()
    whitener = linalg.lower_inverse(linalg.cholesky(moments.covariance(loading)))
    white = (targets - mean) @ whitener.T
    weights = np.zeros_like(targets)
    if len(targets):
        solved = linalg.solve_spd(moments.correlation(loading), targets.T).T
        gain = (solved * targets).sum(axis=1)
        some = gain > 0  # a filter without gain stays zero
        weights[some] = solved[some] / gain[some, None]
    parts = (mean, whitener, white, (white * white).sum(axis=1), weights)
    if narrow:
        parts = tuple(x.astype(np.float32).astype(np.float64) for x in parts)
    return Statistics(*parts)


def dense(column: pa.Array) -> np.ndarray:
    """The spectra that a batch has, as rows of doubles. Null ones are left out; ragged ones and null values within are refused."""
    some = column.drop_null()
    sizes = pc.unique(pc.list_value_length(some)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"spectra differ in their number of bands: {sorted(sizes)}")
    flat = some.flatten()
    if flat.null_count:
        raise ValueError("a spectrum has bands without a value")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), sizes[0] if sizes else 0)


PARTIAL = "n double, mean array<double>, products array<double>"


def _row(total: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([total.centre]), pa.array([total.products.reshape(-1)])], names=["n", "mean", "products"])


def partial_moments(pixels: DataFrame, column: str = "spectrum", reference: np.ndarray | None = None) -> DataFrame:
    """One row (n, mean, products) for each task: a matrix product for each Arrow batch, merged. Null spectra are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = dense(b.column(0))
            if len(x):
                one = Moments.of(x, reference)
                total = one if total is None else total.merge(one)
        if total is not None:
            yield _row(total)

    return pixels.select(column).mapInArrow(run, PARTIAL)


def _added(rows: Iterator[tuple[float, list, list]]) -> Moments | None:
    total = None
    for n, mean, products in rows:
        mean = np.asarray(mean, dtype=np.float64)
        one = Moments(n, mean, np.asarray(products, dtype=np.float64).reshape(len(mean), len(mean)))
        total = one if total is None else total.merge(one)
    return total


def merge_moments(partials: DataFrame, tasks: int = MERGE_TASKS) -> DataFrame:
    """Partial rows merged into at most so many rows, in tasks that each hold one running total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            one = _added(zip(b["n"].to_pylist(), b["mean"].to_pylist(), b["products"].to_pylist(), strict=True))
            total = one if total is None else total if one is None else total.merge(one)
        if total is not None:
            yield _row(total)

    return partials.repartition(tasks).mapInArrow(run, PARTIAL)


def moments(pixels: DataFrame, column: str = "spectrum", reference: np.ndarray | None = None) -> Moments:
    """The moments of all pixels. With a reference spectrum, they are taken of differences from it."""
    partials = partial_moments(pixels, column, reference)
    total = _added((r["n"], r["mean"], r["products"]) for r in merge_moments(partials).collect())
    if total is None:
        raise ValueError("no pixels to take statistics from")
    return total if reference is None else total.unshifted(np.asarray(reference, dtype=np.float64))


def band_means(pixels: DataFrame, column: str = "spectrum") -> DataFrame:
    return pixels.select(F.posexplode(column).alias("band", "v")).groupBy("band").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def _triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower triangle of one row of moments."""
    for b in batches:
        total = _added(zip(b["n"].to_pylist(), b["mean"].to_pylist(), b["products"].to_pylist(), strict=True))
        if total is not None:
            i, j = np.tril_indices(len(total.centre))
            columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), int(total.n)), total.o[i, j], total.products[i, j] / total.n, total.centre[i], total.centre[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "product", "covariance", "mean_i", "mean_j"])


def moments_long(pixels: DataFrame, column: str = "spectrum") -> DataFrame:
    """The lower triangle as rows (i, j, n, product, covariance, mean_i, mean_j), from merged matrices: pixels are not multiplied by pairs of bands.

    The last merge is of MERGE_TASKS rows at most. Without pixels there are no rows.
    """
    merged = merge_moments(merge_moments(partial_moments(pixels, column)), 1)
    return merged.mapInArrow(_triangle, "i int, j int, n long, product double, covariance double, mean_i double, mean_j double")


def _loaded(value: str, loading: float) -> Column:
    return F.col(value) + F.when(F.col("i") == F.col("j"), loading).otherwise(0.0)


def covariance_long(pixels: DataFrame, column: str = "spectrum", loading: float = 0.0) -> DataFrame:
    return moments_long(pixels, column).select("i", "j", _loaded("covariance", loading).alias("covariance"))


def correlation_long(pixels: DataFrame, column: str = "spectrum", loading: float = 0.0) -> DataFrame:
    m = moments_long(pixels, column).withColumn("mean_product", F.col("product") / F.col("n"))
    return m.select("i", "j", _loaded("mean_product", loading).alias("correlation"))


def mean_spectrum(pixels: DataFrame, mask: Column, column: str = "spectrum") -> DataFrame:
    """The mean of the pixels in a mask, one row; an empty mask is an error when the row is read."""
    by_band = pixels.where(mask).select(F.posexplode(column).alias("band", "v")).groupBy("band").agg(F.avg(F.col("v").cast("double")).alias("m"))
    whole = by_band.agg(F.sort_array(F.collect_list(F.struct("band", "m"))).alias("e"))
    return whole.select(F.when(F.size("e") == 0, F.raise_error(F.lit("the mask selects no pixels"))).otherwise(F.transform("e", lambda e: e["m"])).alias("values"))


def class_means(pixels: DataFrame, label: str = "label", column: str = "spectrum", bands: int | None = None) -> DataFrame:
    """The mean spectrum of each label over all scenes, weighted by pixels: label, n, values.

    With the number of bands, for a few of them, a row stays one row and spectra of another length are refused.
    """
    if bands is not None:
        checked = F.when(F.size(column) == bands, F.col(column)).otherwise(F.raise_error(F.lit(f"a spectrum doesn't have {bands} bands")))
        whole = pixels.where(F.col(column).isNotNull()).select(F.col(label).alias("label"), checked.alias("s"))
        means = whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("s", F.lit(b)).cast("double")).alias(f"m{b}") for b in range(bands)])
        return means.select("label", "n", F.array(*[f"m{b}" for b in range(bands)]).alias("values"))
    by_band = pixels.select(F.col(label).alias("label"), F.posexplode(column).alias("band", "v")).groupBy("label", "band").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return by_band.groupBy("label").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("band", "m"))).alias("e")).select("label", "n", F.transform("e", lambda e: e["m"]).alias("values"))


def class_library(pixels: DataFrame, names: dict[int, str] | None = None, label: str = "label", column: str = "spectrum") -> Library:
    """A library of the class means in the order of labels; more labels than a library holds are refused."""
    rows = class_means(pixels, label, column).orderBy("label").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"a library holds at most {MOST_TARGETS} targets")
    names = names or {}
    return Library(tuple(names.get(r["label"], str(r["label"])) for r in rows), np.array([r["values"] for r in rows]))
