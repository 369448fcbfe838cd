import numpy as np
import pytest
from helpers import pixel_table
from pyspark.sql import functions as F

from prismlake.functions.linalg import SingularMatrix, cholesky
from prismlake.operators import moments as M


def scene(n=500, bands=4):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (n, bands))
    x[:, 1] = x[:, 0]
    return x


def test_mean_covariance_and_loading():
    x = scene()
    m = M.Moments.of(x)
    assert np.abs(m.mean() - x.mean(axis=0)).max() < 1e-9
    assert np.abs(m.covariance() - np.cov(x.T, bias=True)).max() < 1e-6
    with pytest.raises(SingularMatrix):
        cholesky(m.covariance(-1e-9))
    cholesky(m.covariance(1e-3))


def test_merge_is_one_pass():
    x = np.random.default_rng(1).uniform(size=(200, 6))
    a = M.Moments.of(x[:70]).merge(M.Moments.of(x[70:]))
    b = M.Moments.of(x)
    assert a.n == b.n and np.abs(a.s - b.s).max() < 1e-11 and np.abs(a.o - b.o).max() < 1e-11


def test_shifted_sums():
    x = np.random.default_rng(2).uniform(size=(300, 5))
    r = np.full(5, 0.41)
    a, b = M.Moments.of(x, r).unshifted(r), M.Moments.of(x)
    assert np.abs(a.covariance() - b.covariance()).max() < 1e-13
    assert np.abs(a.correlation() - b.correlation()).max() < 1e-13


def test_tables_agree_with_arrays(spark):
    x = np.random.default_rng(3).uniform(size=(7, 9, 5)).astype(np.float32)
    px = pixel_table(spark, x)
    expected = M.Moments.of(x.reshape(-1, 5))
    for got in (M.moments(px), M.moments(px, reference=np.full(5, 0.5))):
        assert got.n == 63 and np.allclose(got.s, expected.s) and np.allclose(got.o, expected.o)
    for r in M.covariance_long(px).collect():
        assert r["covariance"] == pytest.approx(expected.covariance()[r["i"], r["j"]], abs=1e-12)
    for r in M.correlation_long(px, loading=0.5).collect():
        assert r["correlation"] == pytest.approx(expected.correlation(0.5)[r["i"], r["j"]])
    assert [r["mean"] for r in M.band_means(px).orderBy("band").collect()] == pytest.approx(expected.mean().tolist())


def test_masked_mean(spark):
    cube = np.array([[[10 * b + p for b in range(3)] for p in (0, 1)], [[10 * b + p for b in range(3)] for p in (2, 3)]], dtype=float)
    px = pixel_table(spark, cube)
    assert M.mean_spectrum(px, F.col("p").isin(0, 3)).first()["values"] == [1.5, 11.5, 21.5]
    with pytest.raises(Exception, match="no pixels"):
        M.mean_spectrum(px, F.lit(False)).collect()


def test_class_means_weigh_pixels(spark):
    a = pixel_table(spark, np.array([[[1.0, 2.0]]])).withColumn("label", F.lit(1))
    b = pixel_table(spark, np.array([[[4.0, 8.0], [4.0, 8.0]]])).withColumn("label", F.lit(1))
    library = M.class_library(a.unionByName(b), {1: "blood"})
    assert library.names == ("blood",) and library.values.tolist() == [[3.0, 6.0]]


def test_no_pixels(spark):
    with pytest.raises(ValueError):
        M.moments(pixel_table(spark, np.zeros((1, 1, 2))).where("false"))
    with pytest.raises(ValueError):
        M.Moments.none(3).mean()


def test_more_labels_than_a_library_holds_are_refused(spark):
    labelled = lambda n: spark.range(n).select(F.col("id").alias("label"), F.array(F.col("id").cast("float")).alias("spectrum"))
    assert M.class_library(labelled(4096)).values.shape == (4096, 1)
    with pytest.raises(ValueError, match="at most 4096"):
        M.class_library(labelled(4097))


def test_null_and_ragged_spectra(spark):
    import numpy as np
    import pytest

    from prismlake.operators import moments as M
    from prismlake.operators import scoring as S
    from prismlake.operators.library import Library

    rng = np.random.default_rng(8)
    x = rng.random((64, 12))
    rows = [(0, k, [float(v) for v in x[k]] if k != 5 else None) for k in range(64)]
    df = spark.createDataFrame(rows, "frame_index long, p long, spectrum array<double>")
    got, want = M.moments(df), M.Moments.of(np.delete(x, 5, axis=0))
    assert got.n == 63 and np.allclose(got.s, want.s) and np.allclose(got.o, want.o)
    lib = Library(("a", "b"), rng.random((2, 12)))
    stats = M.build_statistics(got, lib, 1e-3)
    for name, lost in (("sam", (-1, float("inf"))), ("ace", (-1, 0.0)), ("cem", (-1, 0.0)), ("rx", (-1, float("nan")))):
        forms = [{r["p"]: (r["target"], r["score"]) for r in S.score(df, name, lib, stats, strategy=form).collect()} for form in ("sql", "arrow")]
        assert all(np.allclose(forms[0][p], forms[1][p], equal_nan=True) for p in range(64)), name
        assert np.allclose(forms[0][5], lost, equal_nan=True), name
    ragged = df.union(spark.createDataFrame([(0, 64, [1.0, 2.0])], df.schema)).coalesce(1)
    with pytest.raises(Exception, match="number of bands"):
        M.moments(ragged)
    for form in ("sql", "arrow"):
        with pytest.raises(Exception, match="number of bands"):
            S.sam_best(ragged, lib, strategy=form).collect()


def test_data_far_from_zero_keep_their_digits(spark):
    """Offset 1e6, without a reference: partial results of many tasks merge to the covariance of the centred data."""
    x = np.random.default_rng(11).normal(size=(4000, 4))
    far = x + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in far], "spectrum array<double>").repartition(7)
    want = np.cov((far - 1e6).T, bias=True)
    assert np.abs(M.moments(df).covariance() - want).max() < 1e-9
    for r in M.covariance_long(df).collect():
        assert abs(r["covariance"] - want[r["i"], r["j"]]) < 1e-9
    raw = (far.T @ far) / len(far) - np.outer(far.mean(axis=0), far.mean(axis=0))
    assert np.abs(raw - want).max() > 1e-6  # what sums alone would give


def test_merging_with_nothing_and_long_form_of_nothing(spark):
    x = np.random.default_rng(12).uniform(size=(9, 3))
    a, none = M.Moments.of(x), M.Moments.none(3)
    assert a.merge(none) is a and none.merge(a) is a and M.Moments.of(x[:0]).n == 0
    assert M.moments_long(spark.createDataFrame([], "spectrum array<double>")).count() == 0
    plan = M.moments_long(spark.createDataFrame([(v.tolist(),) for v in x], "spectrum array<double>"))._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_class_means_of_a_given_number_of_bands(spark):
    from prismlake.operators.moments import class_means

    rows = [("a", [1.0, 2.0]), ("a", [2.0, None]), ("b", None), (None, [3.0, 5.0]), ("c", [None, None])]
    px = spark.createDataFrame(rows, "label string, spectrum array<float>")
    got = [sorted(map(str, class_means(px, **k).collect())) for k in ({}, {"bands": 2})]
    assert got[0] == got[1] and len(got[0]) == 3
    with pytest.raises(Exception, match="doesn't have 3 bands"):
        class_means(px, bands=3).collect()
