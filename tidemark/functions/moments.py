"""Regression from moments: one aggregate row per group, then a tiny dense solve.

Raw rows are never gathered per group. A group of any size shrinks map-side to its count, means and
covariances (Spark merges them without cancellation); only that row of (k+1)(k+4)/2 numbers reaches
the solver, which works on k x k matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOT_FLOOR = 1e-12


def moment_aggs(names: Sequence[str]) -> dict[str, Column]:
    """Count, means and upper-triangle population covariances of complete rows."""
    out = {"n": F.count(F.lit(1)).cast("double")}
    for i, a in enumerate(names):
        out[f"m{i}"] = F.avg(F.col(f"`{a}`"))
        for j in range(i, len(names)):
            out[f"c{i}_{j}"] = F.covar_pop(F.col(f"`{a}`"), F.col(f"`{names[j]}`"))
    return out


def unpack(rec: dict, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean vector and covariance matrix of one moment row over ``k`` variables."""
    means = np.array([rec[f"m{i}"] for i in range(k)], dtype=float)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = rec[f"c{i}_{j}"]
    return float(rec["n"]), means, cov


def slopes(
    n: float, cov: np.ndarray, xs: Sequence[int], y: int, ridge: float
) -> np.ndarray | None:
    """Ridge slopes of y on xs with a free intercept; None when the system is singular."""
    xs = list(xs)
    if not xs:
        return np.zeros(0)
    a = n * cov[np.ix_(xs, xs)] + ridge * np.eye(len(xs))
    if not np.all(np.isfinite(a)):
        return None
    work = a.copy()
    for c in range(len(xs)):
        r = c + int(np.argmax(np.abs(work[c:, c])))
        if abs(work[r, c]) < PIVOT_FLOOR:
            return None
        work[[c, r]] = work[[r, c]]
        work[c + 1 :] -= np.outer(work[c + 1 :, c] / work[c, c], work[c])
    return np.linalg.solve(a, n * cov[xs, y])


def fit_quality(n: float, cov: np.ndarray, xs: Sequence[int], y: int, beta: np.ndarray):
    """Share of y's variance explained by the fitted slopes, clipped to [0, 1]."""
    xs = list(xs)
    total = n * cov[y, y]
    if total <= 1e-24:
        return None
    rest = n * (cov[y, y] - 2 * beta @ cov[xs, y] + beta @ cov[np.ix_(xs, xs)] @ beta)
    return float(min(1.0, max(0.0, 1 - rest / total)))


def scaled(cov: np.ndarray) -> np.ndarray:
    """Correlation matrix; variables without spread become zero rows."""
    var = np.diag(cov)
    flat = var <= 1e-24
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    out = cov / np.outer(scale, scale)
    out[flat, :] = out[:, flat] = 0.0
    return out


def unpack_stack(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariance matrices of a batch of moment rows, stacked on the first axis."""
    means = np.stack([frame[f"m{i}"].to_numpy(float) for i in range(k)], axis=1)
    cov = np.zeros((len(frame), k, k))
    for i in range(k):
        for j in range(i, k):
            cov[:, i, j] = cov[:, j, i] = frame[f"c{i}_{j}"].to_numpy(float)
    return frame["n"].to_numpy(float), means, cov


def scaled_stack(cov: np.ndarray) -> np.ndarray:
    """``scaled`` of a stack of matrices."""
    var = np.diagonal(cov, axis1=1, axis2=2)
    flat = var <= 1e-24
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    out = cov / (scale[:, :, None] * scale[:, None, :])
    return np.where(flat[:, :, None] | flat[:, None, :], 0.0, out)


def slopes_stack(
    n: np.ndarray, cov: np.ndarray, xs: Sequence[int], y: int, ridge: float
) -> tuple[np.ndarray, np.ndarray]:
    """``slopes`` of a stack of systems, solved together, and which of them are sound."""
    xs = list(xs)
    if not xs:
        return np.zeros((len(n), 0)), np.ones(len(n), bool)
    a = n[:, None, None] * cov[:, xs][:, :, xs] + ridge * np.eye(len(xs))
    sound = np.isfinite(a).all(axis=(1, 2))
    a = np.where(sound[:, None, None], a, np.eye(len(xs)))
    work, rows = a.copy(), np.arange(len(n))
    for c in range(len(xs)):
        r = c + np.abs(work[:, c:, c]).argmax(axis=1)
        top = work[rows, r].copy()
        work[rows, r] = work[:, c]
        work[:, c] = top
        sound &= np.abs(top[:, c]) >= PIVOT_FLOOR
        pivot = np.where(sound, top[:, c], 1.0)
        work[:, c + 1 :] -= (work[:, c + 1 :, c] / pivot[:, None])[:, :, None] * top[:, None]
    a = np.where(sound[:, None, None], a, np.eye(len(xs)))
    return np.linalg.solve(a, (n[:, None] * cov[:, xs, y])[:, :, None])[:, :, 0], sound


def residual_stack(cov: np.ndarray, xs: Sequence[int], y: int, beta: np.ndarray) -> np.ndarray:
    """Variance of y that the fitted slopes leave, for each system of a stack."""
    xs = list(xs)
    fitted = np.einsum("bi,bij,bj->b", beta, cov[:, xs][:, :, xs], beta)
    return cov[:, y, y] - 2 * np.einsum("bi,bi->b", beta, cov[:, xs, y]) + fitted


def fit_quality_stack(
    n: np.ndarray, cov: np.ndarray, xs: Sequence[int], y: int, beta: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``fit_quality`` of a stack of systems, and where y has any variance to explain."""
    total = n * cov[:, y, y]
    given = ~(total <= 1e-24)
    rest = n * residual_stack(cov, xs, y, beta)
    return np.fmin(1.0, np.fmax(0.0, 1 - rest / np.where(given, total, 1.0))), given


def solve_batches(
    moments: DataFrame,
    keys: Sequence[str],
    args: Sequence[str],
    schema: str,
    fn: Callable[[pd.DataFrame], list[list[list]]],
) -> DataFrame:
    """Apply ``fn`` to batches of moment rows; for each row it returns zero or more result rows of ``schema``."""
    args, names = list(args), [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in schema.split(', '))}>>")
    def run(*parts: pd.Series) -> pd.Series:
        found = fn(pd.DataFrame(dict(zip(args, parts, strict=True))))
        return pd.Series([[dict(zip(names, row, strict=True)) for row in rows] for rows in found])

    return moments.select(*keys, F.inline(run(*[F.col(a) for a in args])))


def solve_rows(
    moments: DataFrame,
    keys: Sequence[str],
    args: Sequence[str],
    schema: str,
    fn: Callable[[dict], list[list]],
) -> DataFrame:
    """Apply ``fn`` to each moment row; it returns zero or more result rows of ``schema``."""
    args, names = list(args), [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in schema.split(', '))}>>")
    def run(*parts: pd.Series) -> pd.Series:
        frame = pd.DataFrame(dict(zip(args, parts, strict=True)))
        return pd.Series(
            [[dict(zip(names, row, strict=True)) for row in fn(rec)] for rec in frame.to_dict("records")]
        )

    return moments.select(*keys, F.inline(run(*[F.col(a) for a in args])))


def _closed_form(
    moments: DataFrame, keys: Sequence[str], k: int, ridge: float, min_rows: int
) -> DataFrame:
    """One or two regressors as plain columns, without a Python worker."""
    n, y = F.col("n"), k
    cov = {(i, j): F.col(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)}
    a, p = n * cov[0, 0] + ridge, n * cov[0, y]
    if k == 1:
        sound = F.abs(a) >= PIVOT_FLOOR
        beta = [F.try_divide(p, a)]
        fitted = beta[0] * beta[0] * cov[0, 0]
    else:
        b, d, q = n * cov[0, 1], n * cov[1, 1] + ridge, n * cov[1, y]
        det, first = a * d - b * b, F.greatest(F.abs(a), F.abs(b))
        sound = (first >= PIVOT_FLOOR) & (F.abs(det) >= PIVOT_FLOOR * first)
        beta = [F.try_divide(p * d - q * b, det), F.try_divide(q * a - p * b, det)]
        fitted = (
            beta[0] * beta[0] * cov[0, 0]
            + 2 * beta[0] * beta[1] * cov[0, 1]
            + beta[1] * beta[1] * cov[1, 1]
        )
    cross, start = F.lit(0.0), F.col(f"m{y}")
    for i, one in enumerate(beta):
        cross = cross + one * cov[i, y]
        start = start - one * F.col(f"m{i}")
    rest = cov[y, y] - 2 * cross + fitted
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(rest, cov[y, y])))
    return moments.where((n >= min_rows) & sound).select(
        *keys,
        n.cast("long").alias("rows"),
        F.when(n * cov[y, y] > 1e-24, share).alias("r2"),
        start.alias("b0"),
        *[one.alias(f"b{i + 1}") for i, one in enumerate(beta)],
    )


def group_betas(
    df: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    y: str,
    *,
    ridge: float = 0.0,
    min_rows: int = 1,
) -> DataFrame:
    """Ridge coefficients per group of complete rows: ``rows``, ``r2``, ``b0`` (intercept), ``b1``.."""
    aggs = moment_aggs([*xs, y])
    moments = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    k = len(xs)
    if k <= 2:
        return _closed_form(moments, keys, k, ridge, min_rows)

    def fit(rec: dict) -> list[list]:
        n, means, cov = unpack(rec, k + 1)
        beta = slopes(n, cov, range(k), k, ridge) if n >= min_rows else None
        if beta is None:
            return []
        b0 = means[k] - beta @ means[:k]
        return [[int(n), fit_quality(n, cov, range(k), k, beta), float(b0), *map(float, beta)]]

    schema = "rows long, r2 double, " + ", ".join(f"b{i} double" for i in range(k + 1))
    return solve_rows(moments, keys, list(aggs), schema, fit)
