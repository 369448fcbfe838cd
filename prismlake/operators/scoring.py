"""Detectors as projections: a score for each pixel, without a shuffle.

Each has an expression form, in which the library is one constant array, and a
NumPy form over Arrow batches, one matrix product for a batch. "auto" takes the
expression form for few bands and the matrix product otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import spectral
from .library import Library
from .moments import Statistics

#: Bands up to which "auto" takes the expression form.
FEW_BANDS = 8
#: Targets that a pass over an Arrow batch compares its pixels with.
TARGET_BLOCK = 256
_OTHER_BANDS = "pixels have another number of bands"


def _choose(strategy: str, bands: int) -> str:
    named = model.strategy(strategy)
    return named if named != "auto" else "sql" if bands <= FEW_BANDS else "arrow"


def _stack(column: pa.Array, bands: int) -> np.ndarray:
    """Spectra of a batch as rows of doubles; a null one, or a null in one, is NaN. Spectra of another length are refused."""
    out, here = np.full((len(column), bands), np.nan), column.is_valid().to_numpy(zero_copy_only=False)
    some = column.drop_null()
    sizes = set(pc.unique(pc.list_value_length(some)).to_pylist())
    if sizes - {bands}:
        raise ValueError(f"{_OTHER_BANDS}: {sorted(sizes)}, {bands} are expected")
    out[here] = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, bands)
    return out


def _checked(column: str, bands: int) -> Column:
    """The spectrum of the expression forms: null if it or one of its values is null; of another length, it is refused."""
    c = F.col(column)
    usable = F.when(~F.exists(c, lambda v: v.isNull()), c)
    return F.when(F.size(c) == bands, usable).when(c.isNotNull(), F.raise_error(F.lit(_OTHER_BANDS)))


def _project(pixels: DataFrame, column: str, bands: int, schema: str, compute: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Replace the spectra by computed columns, batch by batch."""
    rest = [c for c in pixels.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = compute(_stack(b.column(b.schema.get_field_index(column)), bands))
                arrays = [b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(v) for v in got.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *got])

    fields = ", ".join(f"`{c}` {t}" for c, t in pixels.select(*rest).dtypes)
    return pixels.select(*rest, column).mapInArrow(run, f"{fields}, {schema}")


def _angles(x: np.ndarray, targets: np.ndarray, norms: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.arccos(np.clip((x @ targets.T) / (length[:, None] * norms[None, :]), -1, 1))
    out[length == 0] = spectral.RIGHT_ANGLE
    out[:, norms == 0] = spectral.RIGHT_ANGLE
    return out


def _first_best(scores: np.ndarray, lower: bool, none: float) -> dict[str, np.ndarray]:
    """The best column of each row, the first of equals; (none, -1) where no score is a number."""
    lost = np.inf if lower else -np.inf
    s = np.where(np.isnan(scores), lost, scores)
    if not s.shape[1]:
        return {"target": np.full(len(s), -1, np.int32), "score": np.full(len(s), none)}
    at = s.argmin(axis=1) if lower else s.argmax(axis=1)
    best = s[np.arange(len(s)), at]
    valid = best != lost
    return {"target": np.where(valid, at, -1).astype(np.int32), "score": np.where(valid, best, none)}


def _nearest(x: np.ndarray, targets: np.ndarray, norms: np.ndarray) -> dict[str, np.ndarray]:
    """The best target of each row by passes over blocks of targets: no more than a block's angles are held at a time."""
    best = None
    for first in range(0, len(targets), TARGET_BLOCK):
        one = _first_best(_angles(x, targets[first : first + TARGET_BLOCK], norms[first : first + TARGET_BLOCK]), True, np.inf)
        one["target"] = np.where(one["target"] >= 0, one["target"] + first, -1).astype(np.int32)
        if best is None:
            best = one
        else:  # an equal target of a later block doesn't win
            better = one["score"] < best["score"]
            best = {c: np.where(better, one[c], best[c]) for c in best}
    return best


def _or_nan(column: str, score: Column) -> Column:
    return F.when(F.col(column).isNotNull(), score).otherwise(F.lit(float("nan")))


def sam_all(pixels: DataFrame, library: Library, column: str = "spectrum") -> DataFrame:
    """One row for each pixel and target: target, angle. The angle of a null spectrum is NaN."""
    lib = library.literal()
    pixels = pixels.withColumn(column, _checked(column, library.bands))
    energy = pixels.withColumn("__xx", spectral.energy(F.col(column)))
    angles = F.transform(lib, lambda t: F.struct(t["id"].alias("target"), _or_nan(column, spectral.angle(spectral.dot(F.col(column), t["values"]), F.col("__xx"), t["norm"])).alias("angle")))
    rest = [c for c in pixels.columns if c != column]
    return energy.select(*rest, F.inline(angles))


def _with_best(df: DataFrame, candidates: Column, lower: bool, none: float) -> DataFrame:
    """df with target and score, the best of an array of (score, target) structs; ties go to the lower id, NaN never wins, and (none, -1) stands for nothing.

    The struct goes through a generator as a whole, so that it is computed once, not once for each of its fields.
    """
    sign = 1 if lower else -1
    usable = F.filter(candidates, lambda s: ~F.isnan(s["score"]))
    best = F.array_min(F.transform(usable, lambda s: F.struct((s["score"] * sign).alias("__s"), s["target"].alias("__t"))))
    one = F.coalesce(best, F.struct(F.lit(float(none) * sign).alias("__s"), F.lit(-1).alias("__t")))
    return df.select("*", F.inline(F.array(one))).withColumns({"target": F.col("__t").cast("int"), "score": F.col("__s") * sign}).drop("__s", "__t")


def sam_best(pixels: DataFrame, library: Library, column: str = "spectrum", strategy: str = "auto") -> DataFrame:
    """The nearest target of each pixel: target, score (its angle); (-1, infinity) without targets and for null spectra."""
    if not len(library.names):
        return pixels.drop(column).withColumns({"target": F.lit(-1), "score": F.lit(float("inf"))})
    if _choose(strategy, library.bands) == "arrow":
        targets, norms = library.values.astype(np.float64), library.norms()
        return _project(pixels, column, library.bands, "target int, score double", lambda x: _nearest(x, targets, norms))
    rest = [c for c in pixels.columns if c != column]
    ready = pixels.withColumn(column, _checked(column, library.bands)).withColumn("__xx", spectral.energy(F.col(column)))
    each = F.transform(library.literal(), lambda t: F.struct(_or_nan(column, spectral.angle(spectral.dot(F.col(column), t["values"]), F.col("__xx"), t["norm"])).alias("score"), t["id"].alias("target")))
    return _with_best(ready, each, True, float("inf")).select(*rest, "target", "score")


def _matrix_literal(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.atleast_2d(m)])


def _whitened(pixels: DataFrame, column: str, stats: Statistics) -> DataFrame:
    """pixels with __z, the centred and whitened spectrum. A generator keeps the centring out of the loop over the whitener's rows."""
    centred = F.zip_with(_checked(column, len(stats.mean)), F.array(*[F.lit(float(v)) for v in stats.mean]), lambda x, m: x.cast("double") - m)
    ready = pixels.select("*", F.explode(F.array(centred)).alias("__c"))
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("__c"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return ready.withColumn("__z", F.transform(_matrix_literal(stats.whitener), dot)).withColumn("__z", F.when(F.col("__c").isNotNull(), F.col("__z")))


def rx(pixels: DataFrame, stats: Statistics, column: str = "spectrum", strategy: str = "auto") -> DataFrame:
    """The squared Mahalanobis distance to the scene's mean: score; NaN for null spectra."""
    rest = [c for c in pixels.columns if c != column]
    if _choose(strategy, len(stats.mean)) == "arrow":
        mean, w = stats.mean, stats.whitener
        return _project(pixels, column, len(mean), "score double", lambda x: {"score": (((x - mean) @ w.T) ** 2).sum(axis=1)})
    return _whitened(pixels, column, stats).select(*rest, _or_nan("__z", spectral.energy(F.col("__z"))).alias("score"))


def ace_best(pixels: DataFrame, stats: Statistics, column: str = "spectrum", strategy: str = "auto", with_rx: bool = False) -> DataFrame:
    """The target with the largest squared cosine in whitened space: target, score in [0, 1], and rx if asked for.

    Targets or pixels without energy there are left out, null spectra too; where nothing is left, (-1, 0).
    """
    rest = [c for c in pixels.columns if c != column]
    u, uu = stats.target_white, stats.target_norm2
    if _choose(strategy, len(stats.mean)) == "arrow":
        mean, w = stats.mean, stats.whitener

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            z = (x - mean) @ w.T
            zz = (z * z).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.minimum(1.0, (z @ u.T) ** 2 / (zz[:, None] * uu[None, :])) if len(u) else np.zeros((len(x), 0))
            s[:, uu <= 0] = np.nan
            s[zz <= 0] = np.nan
            out = _first_best(s, False, 0.0)
            return out | {"rx": zz} if with_rx else out

        return _project(pixels, column, len(mean), "target int, score double" + ", rx double" * with_rx, compute)
    usable = [i for i in range(len(u)) if uu[i] > 0]
    ready = _whitened(pixels, column, stats).select(*rest, F.explode(F.array(F.struct("__z", spectral.energy(F.col("__z")).alias("__zz")))).alias("__w")).select(*rest, "__w.*")
    if usable:
        lib = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(v)) for v in u[i]]).alias("u"), F.lit(float(uu[i])).alias("uu")) for i in usable])
        scored = F.transform(lib, lambda t: F.struct(F.when((F.col("__zz") > 0) & ~F.isnan("__zz"), F.least(F.lit(1.0), spectral.dot(F.col("__z"), t["u"]) ** 2 / (F.col("__zz") * t["uu"]))).otherwise(F.lit(float("nan"))).alias("score"), t["id"].alias("target")))
        ready = _with_best(ready, scored, False, 0.0)
    else:
        ready = ready.withColumns({"target": F.lit(-1), "score": F.lit(0.0)})
    return ready.select(*rest, "target", "score", *([_or_nan("__z", F.col("__zz")).alias("rx")] if with_rx else []))


def cem_best(pixels: DataFrame, stats: Statistics, column: str = "spectrum", strategy: str = "auto") -> DataFrame:
    """The target whose filter responds most to the pixel: target, score; (-1, 0) for null spectra."""
    w = stats.cem_weight
    if not len(w):
        return pixels.drop(column).withColumns({"target": F.lit(-1), "score": F.lit(0.0)})
    if _choose(strategy, len(stats.mean)) == "arrow":
        return _project(pixels, column, w.shape[1], "target int, score double", lambda x: _first_best(x @ w.T, False, 0.0))
    rest = [c for c in pixels.columns if c != column]
    lib = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(v)) for v in row]).alias("w")) for i, row in enumerate(w)])
    scored = F.transform(lib, lambda t: F.struct(_or_nan(column, spectral.dot(F.col(column), t["w"])).alias("score"), t["id"].alias("target")))
    return _with_best(pixels.withColumn(column, _checked(column, w.shape[1])), scored, False, 0.0).select(*rest, "target", "score")


def score(pixels: DataFrame, detector: str, library: Library | None = None, stats: Statistics | None = None, column: str = "spectrum", strategy: str = "auto") -> DataFrame:
    """Any detector by name: target (-1 where the detector has none) and score."""
    traits = model.detector(detector)
    if traits.needs_targets and library is None:
        raise ValueError(f"{traits.name} needs a library")
    if traits.needs_statistics and stats is None:
        raise ValueError(f"{traits.name} needs the scene's statistics")
    if traits.name == "sam":
        return sam_best(pixels, library, column, strategy)
    if traits.name == "rx":
        return rx(pixels, stats, column, strategy).withColumn("target", F.lit(-1))
    return (ace_best if traits.name == "ace" else cem_best)(pixels, stats, column, strategy)
