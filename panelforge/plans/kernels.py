"""Queries whose kernels run by group on the executors: names, the panels they read, and the operator."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import models, screening, statistics, unitroot

SECTOR = "cast((cast(substr(ticker, 7, 2) as int) - 1) % 5 as int)"
RETURNS = f"select ticker, {SECTOR} as g, d, cast(dense_rank() over (order by d) as bigint) as i, r from walk"


def _signals(df: DataFrame, **settings) -> DataFrame:
    cfg = models.ResidualConfig(year=52, kappa_min=1.0, **settings)
    return models.residual_signals(df.select("ticker", "i", "r"), cfg)


def _fold_table(df: DataFrame) -> DataFrame:
    return screening.folds(df.select("d", "i").distinct())


def _screened(df: DataFrame) -> DataFrame:
    """The screen of every fold's training rows."""
    folds = _fold_table(df)
    train = df.join(F.broadcast(folds), (F.col("i") >= F.col("train_first")) & (F.col("i") <= F.col("train_last"))).select("fold", "ticker", "g", "i", "r")
    return screening.screen_pairs(train, screening.ScreenConfig(max_lag=2))


def _walked(df: DataFrame, selector: str) -> DataFrame:
    return screening.walk_forward(df, _fold_table(df), screening.ScreenConfig(max_lag=2, alpha=0.2), selector=selector)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


DRIFT = 1e-4 / (1 - 1e-4)
#: The Kalman hedge of statistics.kalman() again, as a recursion that other engines run.
KALMAN_CHECK = f"""ks as (
  select y, x, c, b as s0, my as s1, noise, noise / sxx as p00, noise / 60 as p11 from (select y, x, avg(lx) as c, regr_slope(ly, lx) as b, avg(ly) as my, regr_sxx(ly, lx) as sxx, (regr_syy(ly, lx) - power(regr_sxy(ly, lx), 2) / regr_sxx(ly, lx)) / 58 as noise from pair where i <= 60 group by y, x having count(*) = 60) q),
kf as (
  select y, x, 60 as i, s0, s1, p00, 0e0 as p01, p11, c, noise, cast(null as double) as miss, cast(null as double) as v from ks
  union all
  select y, x, i, s0 + g0 * miss / v, s1 + g1 * miss / v, p00 - g0 * g0 / v, p01 - g0 * g1 / v, p11 - g1 * g1 / v, c, noise, miss, v
  from (select *, h * g0 + g1 + noise as v, ly - h * s0 - s1 as miss from (select *, p00 * h + p01 as g0, p01 * h + p11 as g1 from (
    select f.y, f.x, n.i, f.s0, f.s1, f.p00 + {DRIFT!r} as p00, f.p01, f.p11 + {DRIFT!r} as p11, f.c, f.noise, n.lx - f.c as h, n.ly from kf f join pair n on n.y = f.y and n.x = f.x and n.i = f.i + 1) a) b) e)"""
KALMAN_SELECT = "select p.y, p.x, p.d, round(k.s0, 5) as beta, round(k.s1 - k.s0 * k.c, 5) as alpha, round(k.miss, 6) as innovation, round(sqrt(k.v), 6) as sd from pair p left join kf k on k.y = p.y and k.x = p.x and k.i = p.i and k.i > 60"


def _kalman(df: DataFrame) -> DataFrame:
    found = statistics.by_pair(df, "hedges")
    return found.select("y", "x", "d", *[F.round(F.nanvl(c, F.lit(None)), n).alias(c) for c, n in (("beta", 5), ("alpha", 5), ("innovation", 6), ("sd", 6))])


# name: (panels, select, operator)
QUERIES = {
    "kalman_hedge": (["pair"], "select y, x, i, d, ly, lx from pair", _kalman),
    "adf_p_values": (["walk"], "select ticker, cast(i as int) as i, ln(close) as v from walk", unitroot.tests_by_ticker),
    "johansen_ranks": (["walk"], f"select {SECTOR} as g, ticker, d, ln(close) as v from walk", unitroot.ranks_by_group),
    "ou_mle": (["walk"], "select ticker, cast(i as int) as i, ln(close) as v from walk", lambda df: _rounded(models.ou_by_ticker(df))),
    "cluster_groups": (["walk"], f"""select cast((cast(substr(a.ticker, 7, 2) as int) - 1) % 5 as int) as g, a.ticker as a, b.ticker as b, round(sqrt(greatest(0e0, (1 - corr(a.r, b.r)) / 2)), 9) as dist
  from walk a join walk b on a.d = b.d and {SECTOR.replace("ticker", "a.ticker")} = {SECTOR.replace("ticker", "b.ticker")} group by a.ticker, b.ticker""", models.cluster_groups),
    "residual_signals": (["walk"], RETURNS, partial(_signals, factors=3)),
    "reversal_signals": (["walk"], RETURNS, partial(_signals, factors=0, signal="reversal")),
    "screen_pairs": (["walk"], RETURNS, lambda df: _rounded(_screened(df))),
    "screen_summary": (["walk"], RETURNS, lambda df: screening.screen_summary(_screened(df))),
    "walk_forward": (["walk"], RETURNS, partial(_walked, selector="screen")),
    "walk_forward_random": (["walk"], RETURNS, partial(_walked, selector="random")),
}
