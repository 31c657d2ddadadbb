"""Unit-root and cointegration tests with p-values, critical values and rank decisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelforge.functions.normal import normal_cdf
from panelforge.operators.statistics import TRENDS, least_squares, trend

# MacKinnon's (1994) surfaces. By trend and number of series: the switch point, the ends, the small and the large polynomial.
SURFACES = {
    ("n", 1): (-1.04, -19.04, math.inf, (0.6344, 1.2378, 3.2496e-2), (0.4797, 9.3557e-1, -0.6999e-1, 3.3066e-2)),
    ("n", 2): (-1.53, -19.62, 1.51, (1.9129, 1.3857, 3.5322e-2), (1.5578, 8.558e-1, -2.083e-1, -3.3549e-2)),
    ("c", 1): (-1.61, -18.83, 2.74, (2.1659, 1.4412, 3.8269e-2), (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)),
    ("c", 2): (-2.62, -18.86, 0.92, (2.92, 1.5012, 3.9796e-2), (2.1945, 6.4695e-1, -2.9198e-1, -4.2377e-2)),
    ("ct", 1): (-2.89, -16.18, 0.70, (3.2512, 1.6047, 4.9588e-2), (2.5261, 6.1654e-1, -3.7956e-1, -6.0285e-2)),
    ("ct", 2): (-3.19, -21.15, 0.63, (3.6646, 1.5419, 3.6448e-2), (2.85, 5.272e-1, -3.6622e-1, -5.1695e-2)),
}
# MacKinnon's (2010) critical values at 1, 5 and 10 %, as polynomials of 1 / observations.
CRITICAL = {
    ("n", 1): ((-2.56574, -2.2358, -3.627, 0), (-1.941, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)),
    ("c", 1): ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0)),
    ("c", 2): ((-3.89644, -10.9519, -22.527, 0), (-3.33613, -6.1101, -6.823, 0), (-3.04445, -4.2412, -2.72, 0)),
    ("ct", 1): ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.38)),
    ("ctt", 1): ((-4.37113, -11.5882, -35.819, -334.047), (-3.83239, -5.9057, -12.49, -118.284), (-3.55326, -3.6596, -5.293, -63.559)),
}
# Critical values at 90, 95 and 99 % of the trace and the largest eigenvalue with a constant, by the number of common trends, 1 to 10.
TRACE = ((2.7055, 3.8415, 6.6349), (13.4294, 15.4943, 19.9349), (27.0669, 29.7961, 35.4628), (44.4929, 47.8545, 54.6815), (65.8202, 69.8189, 77.8202),
         (91.109, 95.7542, 104.9637), (120.3673, 125.6185, 135.9825), (153.6341, 159.529, 171.0905), (190.8714, 197.3772, 210.0366), (232.103, 239.2468, 253.2526))
LARGEST = ((2.7055, 3.8415, 6.6349), (12.2971, 14.2639, 18.52), (18.8928, 21.1314, 25.865), (25.1236, 27.5858, 32.7172), (31.2379, 33.8777, 39.3693),
           (37.2786, 40.0763, 45.8662), (43.2947, 46.2299, 52.3069), (49.2855, 52.3622, 58.6634), (55.2412, 58.4332, 64.996), (61.2041, 64.504, 71.2525))
LEVELS = (0.90, 0.95, 0.99)


def p_value(stat: float, kind: str = "c", series: int = 1) -> float:
    """The probability of a smaller statistic under a unit root; NaN where no surface is known."""
    if (kind, series) not in SURFACES or math.isnan(stat):
        return math.nan
    switch, low, high, small, large = SURFACES[kind, series]
    if stat > high or stat < low:
        return float(stat > high)
    return normal_cdf(sum(c * stat**k for k, c in enumerate(small if stat <= switch else large)))


def critical_values(n: int, kind: str = "c", series: int = 1) -> tuple[float, float, float]:
    """At 1, 5 and 10 % with n observations; NaN where no polynomial is known."""
    return tuple(sum(c / n**k for k, c in enumerate(row)) for row in CRITICAL.get((kind, series), ((math.nan,),) * 3))


@dataclass(frozen=True)
class UnitRoot:
    stat: float
    p: float
    lag: int
    n: int
    critical: tuple[float, float, float]


def adf_test(x: np.ndarray, kind: str = "c", max_lag: int | None = None, choose: str | None = "aic") -> UnitRoot:
    """Augmented Dickey-Fuller. choose: aic or bic on a sample that all lags share, the shortest of the best; None takes max_lag."""
    x = np.asarray(x, float)
    dx = np.diff(x)
    if max_lag is None:
        max_lag = max(0, int(min(len(x) // 2 - TRENDS[kind] - 1, math.ceil(12 * (len(x) / 100) ** 0.25))))

    def regression(lag: int, skip: int):
        y = dx[skip:]
        past = [x[skip:-1], *(dx[skip - j : len(dx) - j] for j in range(1, lag + 1))]
        return *least_squares(y, np.column_stack([*past, trend(len(y), kind)])), len(y)

    def cost(lag: int) -> float:
        beta, ssr, _, m = regression(lag, max_lag)
        return m * (math.log(2 * math.pi * ssr / m) + 1) + len(beta) * (2 if choose == "aic" else math.log(m))

    lag = max_lag if choose is None else min((cost(k), k) for k in range(max_lag + 1))[1]
    beta, ssr, inverse, m = regression(lag, lag)
    stat = float(beta[0] / math.sqrt(ssr / (m - len(beta)) * inverse[0, 0]))
    return UnitRoot(stat, p_value(stat, kind), lag, m, critical_values(m, kind))


def engle_granger_test(y: np.ndarray, x: np.ndarray, kind: str = "c", choose: str | None = "aic", max_lag: int | None = None) -> tuple[UnitRoot, np.ndarray]:
    """The test of the residuals of y on x and the trend, and its coefficients, slopes first; a perfect fit is an error."""
    x = np.asarray(x, float).reshape(len(y), -1)
    beta, ssr, _ = least_squares(np.asarray(y, float), design := np.column_stack([x, trend(len(y), kind)]))
    if ssr <= 1e-8 * float(((y - np.mean(y)) ** 2).sum()):
        raise ValueError("the series are collinear")
    own = adf_test(y - design @ beta, "n", max_lag, choose)
    series = x.shape[1] + 1
    return UnitRoot(own.stat, p_value(own.stat, kind, series), own.lag, own.n, critical_values(own.n, kind, series)), beta


@dataclass(frozen=True)
class Johansen:
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: np.ndarray
    largest: np.ndarray
    trace_critical: np.ndarray
    largest_critical: np.ndarray

    def rank(self, level: float = 0.95, by: str = "trace") -> int:
        """The first rank whose statistic is not above its critical value."""
        stat, critical = (self.trace, self.trace_critical) if by == "trace" else (self.largest, self.largest_critical)
        return next((r for r in range(len(stat)) if stat[r] <= critical[r, LEVELS.index(level)]), len(stat))

    def vector(self, k: int = 0, one: int = 0) -> np.ndarray:
        """A cointegrating vector, scaled so that one of its components is 1."""
        return self.vectors[:, k] / self.vectors[one, k]


def johansen_test(x: np.ndarray, det_order: int = 0, lags: int = 1) -> Johansen:
    """Trace and largest-eigenvalue statistics of a basket (rows by series) of up to 10 series; det_order -1 has no constant, 0 one, 1 a trend (critical values with a constant only)."""
    x = np.asarray(x, float)
    n = x.shape[1]
    if det_order not in (-1, 0, 1) or lags < 0 or n > 10:
        raise ValueError("det_order is -1, 0 or 1, lags 0 or more, series 10 or fewer")
    dx = np.diff(x, axis=0)
    now, level = dx[lags:], x[lags:-1]
    short = [dx[lags - j : len(dx) - j] for j in range(1, lags + 1)] + [trend(len(now), "nc"[det_order >= 0] if det_order < 1 else "ct")]
    design = np.column_stack(short)
    q = np.linalg.qr(design)[0] if design.shape[1] else np.zeros((len(now), 0))
    a, b = now - q @ (q.T @ now), level - q @ (q.T @ level)
    m = len(a)
    saa, sab, sbb = a.T @ a / m, a.T @ b / m, b.T @ b / m
    root = np.linalg.inv(np.linalg.cholesky(sbb))
    values, vectors = np.linalg.eigh(root @ sab.T @ np.linalg.solve(saa, sab) @ root.T)
    values, vectors = values[::-1], root.T @ vectors[:, ::-1]
    largest = -m * np.log1p(-np.clip(values, 0, 1 - 1e-15))
    known = det_order == 0
    tables = [np.array([t[n - r - 1] if known else (math.nan,) * 3 for r in range(n)]) for t in (TRACE, LARGEST)]
    return Johansen(values, vectors, np.cumsum(largest[::-1])[::-1], largest, *tables)


def tests_by_ticker(df: DataFrame) -> DataFrame:
    """df (ticker, i, v): the unit-root test of each ticker with its p-value and critical values; under 20 rows give nulls."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("i")["v"].to_numpy()
        t = adf_test(v) if len(v) >= 20 else UnitRoot(None, None, None, len(v), (None,) * 3)
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "stat": [t.stat], "p": [t.p], "lag": [t.lag], "crit_1": [t.critical[0]], "crit_5": [t.critical[1]], "crit_10": [t.critical[2]]})

    return df.groupBy("ticker").applyInPandas(one, "ticker string, stat double, p double, lag int, crit_1 double, crit_5 double, crit_10 double")


def ranks_by_group(df: DataFrame) -> DataFrame:
    """df (g, ticker, d, v): the cointegration rank of each basket over the dates that all its tickers have; too few of them give no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="d", columns="ticker", values="v").dropna().sort_index()
        if len(wide) < 10 * wide.shape[1]:
            return pd.DataFrame({"g": [], "trace_rank": [], "largest_rank": []})
        t = johansen_test(wide.to_numpy())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "trace_rank": [t.rank()], "largest_rank": [t.rank(by="largest")]})

    return df.groupBy("g").applyInPandas(one, "g int, trace_rank int, largest_rank int")
