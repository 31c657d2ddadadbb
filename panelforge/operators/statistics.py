"""Statistics that SQL can't state: unit-root regressions with lag choice, Johansen, Kalman hedges, PCA.

Each group that goes to Python is one ticker, pair or basket, as long as the calendar at most.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRENDS = {"n": 0, "c": 1, "ct": 2, "ctt": 3}


def least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, sum of squared residuals and inverse of the moments, by QR; collinear columns are an error."""
    q, r = np.linalg.qr(x)
    size = np.abs(np.diag(r))
    if len(y) <= x.shape[1] or size.min() <= 1e-12 * max(size.max(), 1e-300):
        raise ValueError("columns are collinear, or rows too few")
    beta = np.linalg.solve(r, q.T @ y)
    rest = y - x @ beta
    inverse = np.linalg.inv(r)
    return beta, float(rest @ rest), inverse @ inverse.T


def trend(n: int, kind: str) -> np.ndarray:
    t = np.arange(1, n + 1, dtype=float)
    return np.column_stack([t**k for k in range(TRENDS[kind])]) if TRENDS[kind] else np.empty((n, 0))


def adf(x: np.ndarray, kind: str = "c", max_lag: int | None = None) -> tuple[float, int, int]:
    """Augmented Dickey-Fuller: statistic, lag and observations; the lag with least AIC on a common sample, then a refit."""
    x = np.asarray(x, dtype=float)
    n, dx = len(x), np.diff(x)
    if max_lag is None:
        max_lag = max(0, int(min(n // 2 - TRENDS[kind] - 1, math.ceil(12 * (n / 100) ** 0.25))))

    def fit(lag: int, skip: int) -> tuple[np.ndarray, float, np.ndarray, int]:
        y = dx[skip:]
        columns = [x[skip:-1]] + [dx[skip - j : len(dx) - j] for j in range(1, lag + 1)]
        design = np.column_stack([*columns, trend(len(y), kind)])
        return *least_squares(y, design), len(y)

    def score(lag: int) -> float:
        beta, ssr, _, m = fit(lag, max_lag)
        return m * (math.log(2 * math.pi) + math.log(ssr / m) + 1) + 2 * len(beta)

    lag = min(range(max_lag + 1), key=lambda k: (score(k), k))
    beta, ssr, inverse, m = fit(lag, lag)
    return float(beta[0] / math.sqrt(ssr / (m - len(beta)) * inverse[0, 0])), lag, m


def engle_granger(y: np.ndarray, x: np.ndarray) -> tuple[float, int, float]:
    """Statistic and lag of the residuals of y on x and a constant, and the slope; a perfect fit is an error."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, ssr, _ = least_squares(y, design)
    if ssr <= 1e-8 * float(((y - y.mean()) ** 2).sum()):
        raise ValueError("the series are collinear")
    stat, lag, _ = adf(y - design @ beta, "n")
    return stat, lag, float(beta[0])


def johansen(x: np.ndarray, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Trace and maximum-eigenvalue statistics of a basket (rows by series), with a constant and `lags` differences."""
    dx = np.diff(x, axis=0)
    left, level = dx[lags:], x[lags:-1]
    short = np.column_stack([np.ones(len(left))] + [dx[lags - j : len(dx) - j] for j in range(1, lags + 1)])
    q, _ = np.linalg.qr(short)
    r0, r1 = left - q @ (q.T @ left), level - q @ (q.T @ level)
    m = len(r0)
    s00, s01, s11 = r0.T @ r0 / m, r0.T @ r1 / m, r1.T @ r1 / m
    root = np.linalg.inv(np.linalg.cholesky(s11))
    values = np.linalg.eigvalsh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)[::-1]
    terms = -m * np.log1p(-np.clip(values, 0, 1 - 1e-15))
    return np.cumsum(terms[::-1])[::-1], terms


def kalman(y: np.ndarray, x: np.ndarray, delta: float = 1e-4, warm: int = 60) -> np.ndarray:
    """Rows of slope, intercept, innovation and its deviation of a random-walk regression; NaN while it warms up."""
    out = np.full((len(y), 4), np.nan)
    if len(y) <= warm:
        return out
    centre = x[:warm].mean()
    design = np.column_stack([x - centre, np.ones(len(x))])
    state, ssr, inverse = least_squares(y[:warm], design[:warm])
    noise = ssr / (warm - 2)
    cov, drift = noise * inverse, delta / (1 - delta) * np.eye(2)
    for t in range(warm, len(y)):
        cov = cov + drift
        h = design[t]
        gain = cov @ h
        var = float(h @ gain) + noise
        miss = float(y[t] - h @ state)
        state = state + gain * (miss / var)
        cov = cov - np.outer(gain, gain) / var
        out[t] = state[0], state[1] - state[0] * centre, miss, math.sqrt(var)
    return out


def pca(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and vectors of a correlation matrix; each vector's largest component is positive."""
    values, vectors = np.linalg.eigh(corr)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def adf_by_ticker(df: DataFrame) -> DataFrame:
    """df (ticker, i, v): test and chosen lag of each ticker; under 20 rows give nulls."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("i")["v"].to_numpy()
        stat, lag, n = adf(v) if len(v) >= 20 else (None, None, len(v))
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "stat": [stat], "lag": [lag], "n": [n]})

    return df.groupBy("ticker").applyInPandas(one, "ticker string, stat double, lag int, n int")


def by_pair(df: DataFrame, kernel: str) -> DataFrame:
    """df (y, x, i, d, ly, lx): Engle-Granger tests in both directions, or Kalman hedges, of each pair."""

    def tests(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        a, b = pdf["ly"].to_numpy(), pdf["lx"].to_numpy()
        one, other = engle_granger(a, b), engle_granger(b, a)
        return pd.DataFrame({"y": [pdf["y"].iloc[0]], "x": [pdf["x"].iloc[0]], "stat_yx": [one[0]], "stat_xy": [other[0]], "lag": [one[1]], "beta": [one[2]], "stat": [min(one[0], other[0])]})

    def hedges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        out = pdf[["y", "x", "d"]].copy()
        out[["beta", "alpha", "innovation", "sd"]] = kalman(pdf["ly"].to_numpy(), pdf["lx"].to_numpy())
        return out

    if kernel == "tests":
        return df.groupBy("y", "x").applyInPandas(tests, "y string, x string, stat_yx double, stat_xy double, lag int, beta double, stat double")
    return df.groupBy("y", "x").applyInPandas(hedges, "y string, x string, d date, beta double, alpha double, innovation double, sd double")


def johansen_by_group(df: DataFrame) -> DataFrame:
    """df (g, ticker, d, v): tests of each basket over the dates that all its tickers have; under 10 of them for each ticker give no rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="d", columns="ticker", values="v").dropna().sort_index()
        if len(wide) < 10 * wide.shape[1]:
            return pd.DataFrame({"g": [], "rank": [], "trace": [], "max_eig": []})
        trace, most = johansen(wide.to_numpy())
        return pd.DataFrame({"g": pdf["g"].iloc[0], "rank": range(len(trace)), "trace": trace, "max_eig": most})

    return df.groupBy("g").applyInPandas(one, "g int, rank int, trace double, max_eig double")


def pca_of_pairs(df: DataFrame) -> DataFrame:
    """df (a, b, rho, n), the correlations of all pairs of a fixed universe, aggregated in Spark: its factors.

    The matrix of one universe goes to one task: its size is the number of names
    squared, whatever the number of rows behind it.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="rho").sort_index(axis=0).sort_index(axis=1)
        values, vectors = pca(m.to_numpy())
        edge = (1 + math.sqrt(len(m) / pdf["n"].min())) ** 2
        k = len(values)
        return pd.DataFrame({
            "factor": np.repeat(np.arange(k), k), "ticker": np.tile(m.index.to_numpy(), k), "eigenvalue": np.repeat(values, k),
            "share": np.repeat(values / values.sum(), k), "beyond_edge": np.repeat(values > edge, k), "loading": vectors.T.ravel(),
        })

    return df.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, "factor int, ticker string, eigenvalue double, share double, beyond_edge boolean, loading double")


# name: (panels, select, kernel)
QUERIES = {
    "adf_aic": (["walk"], "select ticker, cast(i as int) as i, ln(close) as v from walk", adf_by_ticker),
    "engle_granger_aic": (["pair"], "select y, x, i, d, ly, lx from pair", partial(by_pair, kernel="tests")),
    "johansen": (["walk"], "select cast((cast(substr(ticker, 7, 2) as int) - 1) % 5 as int) as g, ticker, d, ln(close) as v from walk", johansen_by_group),
    "pca_factors": (["walk"], "select a.ticker as a, b.ticker as b, corr(a.r, b.r) as rho, count(*) as n from walk a join walk b on a.d = b.d group by a.ticker, b.ticker", pca_of_pairs),
}
