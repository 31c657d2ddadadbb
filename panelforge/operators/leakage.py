"""Checks that a function of a panel does not look ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> float:
    """The largest absolute difference by key; infinite where one side lacks a row or a value."""
    x, y = (df.select(*keys, F.nanvl(value, F.lit(None)).alias(n), F.lit(1).alias(f"has_{n}")) for df, n in ((a, "x"), (b, "y")))
    both = x.join(y, keys, "full")
    gap = F.when(F.col("has_x").isNull() | F.col("has_y").isNull() | (F.col("x").isNull() != F.col("y").isNull()), F.lit(float("inf"))).otherwise(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(0.0)))
    return both.agg(F.coalesce(F.max(gap), F.lit(0.0))).first()[0]


def truncation_invariance(fn: Callable[[DataFrame], DataFrame], df: DataFrame, cuts: list, keys: list[str], value: str, date: str = "d") -> dict:
    """By cut date: how far fn of the data up to there differs from fn of all of it, up to there."""
    whole = fn(df)
    return {c: max_difference(fn(df.where(F.col(date) <= F.lit(c))), whole.where(F.col(date) <= F.lit(c)), keys, value) for c in cuts}


def perturbation_invariance(fn: Callable[[DataFrame], DataFrame], df: DataFrame, cuts: list, keys: list[str], value: str, noisy: list[str], date: str = "d", seed: int = 0) -> dict:
    """By cut date: how far fn moves, up to there, when the columns `noisy` are multiplied by lognormal noise after it."""
    whole, out = fn(df), {}
    for c in cuts:
        noise = F.exp(F.randn(seed))
        other = fn(df.withColumns({n: F.when(F.col(date) > F.lit(c), F.col(n) * noise).otherwise(F.col(n)) for n in noisy}))
        out[c] = max_difference(other.where(F.col(date) <= F.lit(c)), whole.where(F.col(date) <= F.lit(c)), keys, value)
    return out


def worst_violation(found: dict) -> tuple:
    """(cut, difference) of the largest one."""
    return max(found.items(), key=lambda x: x[1])


def assert_no_lookahead(fn: Callable[[DataFrame], DataFrame], df: DataFrame, cuts: list, keys: list[str], value: str, noisy: list[str], tolerance: float = 1e-9, date: str = "d") -> None:
    """An AssertionError if either check finds more than the tolerance."""
    for kind, found in (("truncation", truncation_invariance(fn, df, cuts, keys, value, date)), ("perturbation", perturbation_invariance(fn, df, cuts, keys, value, noisy, date))):
        cut, gap = worst_violation(found)
        if gap > tolerance:
            raise AssertionError(f"{kind}: the output up to {cut} moves by {gap}")
