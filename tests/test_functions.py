import math

import numpy as np
import pytest

from prismlake.functions import chi2, linalg, spectral


def spd(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n))
    return a @ a.T + n * np.eye(n)


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_cholesky_rebuilds_the_matrix(n):
    a = spd(n, n)
    low = linalg.cholesky(a)
    assert np.abs(low @ low.T - a).max() < 1e-9
    assert np.abs(np.triu(low, 1)).max(initial=0) == 0


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.diag([1.0, -4.0]), np.ones((2, 2)) - 1e-9 * np.eye(2), np.array([[np.nan]])])
def test_cholesky_refuses_what_is_not_positive_definite(a):
    with pytest.raises(linalg.SingularMatrix, match="loading"):
        linalg.cholesky(a)


@pytest.mark.parametrize("n", [1, 3, 9, 21])
def test_inverse(n):
    a = spd(n, n + 50)
    assert np.abs(linalg.invert_spd(a) @ a - np.eye(n)).max() < 1e-9


def test_solve_and_quadratic_form():
    a, b = spd(12, 3), np.arange(12.0)
    assert np.abs(a @ linalg.solve_spd(a, b) - b).max() < 1e-9
    y = np.array([1.0, 2.0, 3.0])
    assert linalg.quadratic_form(y, np.eye(3)) == pytest.approx(14)
    assert linalg.quadratic_form(y, linalg.invert_spd(np.diag([4.0, 9.0, 1.0]))) == pytest.approx(1 / 4 + 4 / 9 + 9)


@pytest.mark.parametrize("rate", [0.5, 0.1, 1e-3, 1e-6])
def test_chi_square_with_two_degrees_of_freedom(rate):
    assert chi2.rx_threshold(2, rate) == pytest.approx(-2 * math.log(rate), rel=1e-8)


def test_chi_square_median_and_errors():
    assert 90 < chi2.rx_threshold(100, 0.5) < 100
    for rate in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            chi2.rx_threshold(5, rate)
    assert chi2.gamma_p(3, 0) == 0
    assert chi2.gamma_p(1, 2) == pytest.approx(1 - math.exp(-2), abs=1e-12)
    assert chi2.gamma_p(0.5, 30) == pytest.approx(math.erf(math.sqrt(30)), abs=1e-12)


def test_functions_in_sql(spark):
    spectral.register(spark)
    row = spark.sql("SELECT spectral_angle(array(1D, 0D), array(0D, 2D)) a, spectral_angle(array(0D, 0D), array(1D, 1D)) b, spectral_angle(array(1D, 2D), array(2D, 4D)) c, gamma_p(1D, 2D) g, rx_threshold(2, 0.1D) t").first()
    assert row.a == pytest.approx(math.pi / 2) and row.b == pytest.approx(math.pi / 2, abs=1e-6) and row.c == pytest.approx(0, abs=1e-7)
    assert row.g == pytest.approx(1 - math.exp(-2)) and row.t == pytest.approx(-2 * math.log(0.1))


def test_far_tails_and_arrays():
    for rate in (1e-20, 1e-100, 1e-300):
        assert chi2.rx_threshold(2, rate) == pytest.approx(-2 * math.log(rate), rel=1e-12)
    assert chi2.gamma_q(1, 700.0) == pytest.approx(math.exp(-700.0), rel=1e-12) and chi2.gamma_q(0.5, 100.0) == pytest.approx(math.erfc(10.0), rel=1e-12)
    for bands in (1, 3, 64, 400, 3000):
        for rate in (1 - 1e-9, 0.9, 0.5, 1e-3, 1e-12, 1e-40):
            t = chi2.rx_threshold(bands, rate)
            assert chi2.gamma_q(bands / 2, t / 2) == pytest.approx(rate, rel=1e-8), (bands, rate)
    a, x = np.array([[0.5, 2.0], [7.0, 50.0]]), np.array([[0.1, 9.0], [7.0, 20.0]])
    p, q = chi2.gamma_pq(a, x)
    assert np.allclose(p + q, 1) and all(p[k] == chi2.gamma_p(a[k], x[k]) for k in np.ndindex(2, 2))
    assert chi2.gamma_pq(3.0, np.inf)[0] == 1 and np.isnan(chi2.gamma_pq(np.nan, 1.0)[0])


def test_functions_of_columns_with_nulls(spark):
    spectral.register(spark)
    rows = spark.createDataFrame([(2.0, 1.0, 0.1), (2.0, 1.0, 0.1), (None, 1.0, 0.5), (4.0, None, None), (4.0, 0.0, 0.25)], "a double, x double, r double")
    got = rows.selectExpr("gamma_p(a, x) g", "gamma_q(a, x) q", "rx_threshold(2, r) t").collect()
    assert [r["g"] is None for r in got] == [False, False, True, True, False] and got[4]["g"] == 0 and got[4]["q"] == 1
    assert got[0]["g"] == got[1]["g"] == pytest.approx(1 - 2 * math.exp(-1)) and got[3]["t"] is None and got[2]["t"] == pytest.approx(-2 * math.log(0.5))
    assert rows.where("false").selectExpr("gamma_p(a, x) g").count() == 0
