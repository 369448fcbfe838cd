"""Small dense linear algebra on the driver: matrices of bands by bands."""

from __future__ import annotations

import numpy as np


class SingularMatrix(ValueError):
    """The matrix isn't positive definite; a larger diagonal loading may help."""


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor; a pivot that isn't positive, NaN included, is refused."""
    a = np.asarray(a, dtype=np.float64)
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        low = None
    if low is None or not np.isfinite(low).all() or (np.diag(low) <= 0).any():
        raise SingularMatrix("matrix is not positive definite; raise the diagonal loading")
    return low


def lower_inverse(low: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, lower triangular itself."""
    return np.tril(np.linalg.solve(low, np.eye(len(low))))


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def invert_spd(a: np.ndarray) -> np.ndarray:
    inverse = lower_inverse(cholesky(a))
    return inverse.T @ inverse


def quadratic_form(y: np.ndarray, s_inverse: np.ndarray) -> float:
    return float(y @ s_inverse @ y)
