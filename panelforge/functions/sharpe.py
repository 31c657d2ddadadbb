"""Sharpe ratios under many trials, for the driver; plans.ratios has them as SQL."""

from __future__ import annotations

import math

from panelforge.functions.normal import normal_cdf, normal_ppf

EULER = 0.5772156649015329


def std_error(sr: float, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """The standard error of a Sharpe ratio for each period."""
    return math.sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1))


def psr(sr: float, n: int, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0) -> float:
    """The probability that the true ratio is above the benchmark."""
    return normal_cdf((sr - benchmark) / std_error(sr, n, skew, kurt))


def expected_max_z(trials: float) -> float:
    """The expected largest of so many independent normal draws; 0 of one."""
    if trials < 1:
        raise ValueError("needs one trial at least")
    return 0.0 if trials == 1 else (1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e))


def expected_max_sharpe(variance: float, trials: float) -> float:
    return math.sqrt(variance) * expected_max_z(trials)


def dsr(sr: float, n: int, skew: float, kurt: float, variance: float, trials: float) -> float:
    """psr() against the ratio that the best of so many trials is expected to have by luck."""
    return psr(sr, n, skew, kurt, expected_max_sharpe(variance, trials))


def min_track_record(sr: float, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0, level: float = 0.95) -> float:
    """The fewest periods for a psr() of `level`; infinite at or below the benchmark."""
    if sr <= benchmark:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (normal_ppf(level) / (sr - benchmark)) ** 2


def min_backtest_length(trials: float, target: float = 1.0) -> float:
    """The years below which the best of so many worthless trials is expected to have the target ratio a year."""
    return (expected_max_z(trials) / target) ** 2


def money(x: float) -> str:
    """An amount in dollars as a report shows it: $2.30M, $247K, $3.10B, $12."""
    for unit, name in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= unit:
            return f"${x / unit:.0f}{name}" if name == "K" else f"${x / unit:.2f}{name}"
    return f"${x:.0f}"
