"""Column functions on spectra, and their registration for SQL."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import chi2

#: The angle of a spectrum without energy: pi / 2 as a 32-bit float, widened.
RIGHT_ANGLE = struct.unpack("f", struct.pack("f", math.pi / 2))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def energy(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(energy(a))


def angle(product: Column, energy_x: Column, norm_r: Column) -> Column:
    """The angle from a product, a squared norm and a norm. Without energy on either side, a right angle; cosines are clamped, NaN stays."""
    cosine = product / (F.sqrt(energy_x) * norm_r)
    clamped = F.when(F.isnan(cosine), cosine).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when((energy_x > 0) & (norm_r > 0), F.acos(clamped)).otherwise(F.lit(RIGHT_ANGLE))


def spectral_angle(a: Column, b: Column) -> Column:
    return angle(dot(a, b), energy(a), norm(b))


def _gamma_p(a, x):
    return chi2.gamma_pq(a, x)[0]


def _gamma_q(a, x):
    return chi2.gamma_pq(a, x)[1]


def _rx_threshold(bands, rate):
    return chi2.rx_thresholds(bands, rate)


def _of_pairs(function):
    """A function of two arrays, computed once for each pair of values that a batch has."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        code, pairs = pd.MultiIndex.from_arrays([a.astype(float), b.astype(float)]).factorize(use_na_sentinel=False)
        values = function(pairs.get_level_values(0).to_numpy(dtype=float), pairs.get_level_values(1).to_numpy(dtype=float))
        return pd.Series(values, dtype=float)[code].reset_index(drop=True).where(a.notna() & b.notna())

    return run


def register(spark: SparkSession) -> None:
    """spectral_angle(a, b) as a SQL function of expressions; gamma_p(a, x), gamma_q(a, x) and rx_threshold(bands, rate) as UDFs over Arrow batches. Null gives null."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION spectral_angle(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        CASE WHEN aggregate(a, 0D, (s, v) -> s + v * v) > 0 AND aggregate(b, 0D, (s, v) -> s + v * v) > 0
        THEN acos(greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)
             / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))))))
        ELSE {RIGHT_ANGLE!r}D END"""
    )
    for name, function in (("gamma_p", _gamma_p), ("gamma_q", _gamma_q), ("rx_threshold", _rx_threshold)):
        spark.udf.register(name, F.pandas_udf(_of_pairs(function), "double"))
