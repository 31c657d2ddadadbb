"""The pair screen: candidates, tests in both directions, a null of shifted panels, calibrated p-values, selection; and its walk-forward.

A panel of null returns is one more key beside the fold, so one plan runs all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.models import ou_mle
from panelforge.operators.states import PairRule, pair_positions
from panelforge.operators.unitroot import adf_test, engle_granger_test


@dataclass(frozen=True)
class ScreenConfig:
    neighbours: int = 3
    null_panels: int = 4
    alpha: float = 0.05
    top: int = 20
    max_lag: int | None = None
    year: int = 52


def shift_panels(returns: DataFrame, panels: int, seed: int = 1) -> DataFrame:
    """returns (fold, ticker, g, i, r) with a column panel: 0 as they are, 1 and on with each ticker's returns turned by an offset of its own in [1, n)."""
    n = F.count("*").over(W.partitionBy("fold", "ticker"))
    place = F.row_number().over(W.partitionBy("fold", "ticker").orderBy("i")).cast("long") - 1
    base = returns.withColumn("n", n).withColumn("place", place).withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels))))
    offset = F.when(F.col("panel") == 0, 0).otherwise(1 + F.pmod(F.xxhash64(F.lit(seed), "panel", "fold", "ticker"), F.greatest(F.col("n") - 1, F.lit(1))))
    slots = base.select("fold", "panel", "ticker", "g", "i", F.pmod(F.col("place") + offset, F.col("n")).alias("from_place"))
    source = base.where("panel = 0").select("fold", "ticker", F.col("place").alias("from_place"), "r")
    return slots.join(source, ["fold", "ticker", "from_place"]).drop("from_place")


def levels(returns: DataFrame) -> DataFrame:
    """Log levels of (fold, panel, ticker, g, i, r): the running sum of log returns."""
    run = W.partitionBy("fold", "panel", "ticker").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("lp", F.sum(F.log1p("r")).over(run))


def candidates(returns: DataFrame, k: int) -> DataFrame:
    """(fold, panel, y, x), y before x: pairs of a group in which one is among the other's k most correlated."""
    a, b = returns.alias("a"), returns.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("fold", "panel", "g", "i")]
    rho = a.join(b, [*same, F.col("a.ticker") != F.col("b.ticker")]).groupBy(F.col("a.fold").alias("fold"), F.col("a.panel").alias("panel"), F.col("a.ticker").alias("p"), F.col("b.ticker").alias("q"))
    rho = rho.agg(F.round(F.corr("a.r", "b.r"), 9).alias("rho")).withColumn("k", F.row_number().over(W.partitionBy("fold", "panel", "p").orderBy(F.desc("rho"), "q")))
    return rho.where(F.col("k") <= k).select("fold", "panel", F.least("p", "q").alias("y"), F.greatest("p", "q").alias("x")).distinct()


DIAGNOSED = "fold int, panel int, y string, x string, stat double, stat_yx double, stat_xy double, beta double, alpha double, spread_sd double, half_life double, edge double, beta_first double, beta_second double, half_stat double"


def diagnose(pairs: DataFrame, lps: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Each pair's tests and the fit of its spread; pairs of fewer than 30 common rows or of collinear legs give none."""
    y, x = (lps.select("fold", "panel", F.col("ticker").alias(c), "i", F.col("lp").alias(f"l{c}")) for c in "yx")
    legs = pairs.join(y, ["fold", "panel", "y"]).join(x, ["fold", "panel", "x", "i"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        a, b = pdf["ly"].to_numpy(), pdf["lx"].to_numpy()
        names = [c.split()[0] for c in DIAGNOSED.split(", ")]
        if len(a) < 30:
            return pd.DataFrame({c: [] for c in names})
        try:
            (yx, coef), (xy, _) = engle_granger_test(a, b, max_lag=cfg.max_lag), engle_granger_test(b, a, max_lag=cfg.max_lag)
            spread, half = a - coef[0] * b - coef[1], len(a) // 2
            parts = [np.polyfit(b[s], a[s], 1)[0] for s in (slice(half), slice(half, None))]
            late = adf_test(spread[half:], "n", cfg.max_lag).stat
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame({c: [] for c in names})
        ou = ou_mle(spread, 1 / cfg.year)
        row = [*(pdf[c].iloc[0] for c in ("fold", "panel", "y", "x")), min(yx.stat, xy.stat), yx.stat, xy.stat, coef[0], coef[1], spread.std(ddof=1), ou.half_life * cfg.year, 1e4 * ou.kappa * ou.stationary_sd, *parts, late]
        return pd.DataFrame([row], columns=names)

    return legs.groupBy("fold", "panel", "y", "x").applyInPandas(one, DIAGNOSED)


def empirical_p(tested: DataFrame) -> DataFrame:
    """The real pairs (panel 0) with p = (1 + null statistics at most theirs) / (1 + null statistics) of their fold, by one sort."""
    up = W.partitionBy("fold").orderBy("stat").rangeBetween(W.unboundedPreceding, 0)
    null = F.when(F.col("panel") > 0, 1).otherwise(0)
    counted = tested.withColumn("below", F.sum(null).over(up)).withColumn("nulls", F.sum(null).over(W.partitionBy("fold")))
    return counted.where("panel = 0").withColumn("p", (1 + F.col("below")) / (1 + F.col("nulls"))).drop("below", "panel")


def screen_pairs(returns: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """returns (fold, ticker, g, i, r) of training rows: every candidate with its diagnostics, calibrated p and whether it is selected."""
    panels = shift_panels(returns, cfg.null_panels)
    tested = empirical_p(diagnose(candidates(panels, cfg.neighbours), levels(panels), cfg))
    good = (F.col("p") <= cfg.alpha) & (F.col("beta") > 0)
    return reselect(tested, good, cfg.top)


def reselect(tested: DataFrame, good: Column, top: int) -> DataFrame:
    """tested with `selected`: of the rows that are good, the `top` of each fold with the largest edge."""
    order = W.partitionBy("fold", good).orderBy(F.desc("edge"), "y", "x")
    return tested.withColumn("rank", F.row_number().over(order)).withColumn("selected", good & (F.col("rank") <= top)).drop("rank")


def random_pool(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The pairs that the screen did not find, with a positive slope: what placebo draws are from."""
    return tested.where((F.col("p") > alpha) & (F.col("beta") > 0))


def screen_summary(tested: DataFrame, alphas: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(fold, alpha, n, discoveries, expected, fdr): expected by luck is alpha * n, the false share at most 1."""
    rows = tested.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    out = rows.groupBy("fold", "alpha").agg(F.count("*").alias("n"), F.count_if(F.col("p") <= F.col("alpha")).alias("discoveries"))
    return out.withColumn("expected", F.col("alpha") * F.col("n")).withColumn("fdr", F.when(F.col("discoveries") > 0, F.least(F.lit(1.0), F.col("expected") / F.col("discoveries"))))


def null_size(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Of the null panels of diagnose(): the share that the nominal test at 5 % rejects, by fold."""
    return tested.where("panel > 0").groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("stat_yx") < -3.34).cast("double")).alias("size"))


def folds(sessions: DataFrame, train_years: int = 3, expanding: bool = False, least: int = 100) -> DataFrame:
    """sessions (d, i): (fold, train_first, train_last, test_first, test_last), numbers of sessions; a test year each, with `least` training sessions."""
    years = sessions.groupBy(F.year("d").alias("yr")).agg(F.min("i").alias("test_first"), F.max("i").alias("test_last"))
    past = sessions.select(F.year("d").alias("past"), F.col("i").alias("j"))
    back = F.lit(True) if expanding else F.col("past") >= F.col("yr") - train_years
    out = years.join(F.broadcast(past), (F.col("past") < F.col("yr")) & back).groupBy("yr", "test_first", "test_last").agg(F.min("j").alias("train_first"), F.max("j").alias("train_last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(F.col("yr").alias("fold"), "train_first", "train_last", "test_first", "test_last")


def walk_forward(returns: DataFrame, fold_table: DataFrame, cfg: ScreenConfig = ScreenConfig(), rule: PairRule = PairRule(), window: int = 20, selector: str = "screen") -> DataFrame:
    """returns (ticker, g, d, i, r): the daily P&L of every fold's pairs in its test block, hedged as in training.

    selector: screen takes the selected pairs, random the pool of the others (as
    many, by a hash). All folds and pairs are one DataFrame; positions begin flat
    with the block and end with it.
    """
    train = returns.join(F.broadcast(fold_table), (F.col("i") >= F.col("train_first")) & (F.col("i") <= F.col("train_last"))).select("fold", "ticker", "g", "i", "r")
    tested = screen_pairs(train, cfg)
    if selector == "screen":
        chosen = tested.where("selected")
    else:
        order = W.partitionBy("fold").orderBy(F.xxhash64("y", "x"), "y", "x")
        chosen = random_pool(tested, cfg.alpha).withColumn("k", F.row_number().over(order)).where(F.col("k") <= cfg.top)
    lps = returns.withColumn("lp", F.sum(F.log1p("r")).over(W.partitionBy("ticker").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    y, x = (lps.select(F.col("ticker").alias(c), "i", "d", F.col("lp").alias(f"l{c}"), F.col("r").alias(f"r{c}")) for c in "yx")
    legs = chosen.select("fold", "y", "x", "beta", "alpha").join(F.broadcast(fold_table), "fold").join(y, "y").where((F.col("i") >= F.col("test_first") - window) & (F.col("i") <= F.col("test_last"))).join(x.drop("d"), ["x", "i"])
    spread = F.col("ly") - F.col("beta") * F.col("lx") - F.col("alpha")
    back = W.partitionBy("fold", "y", "x").orderBy("i").rowsBetween(1 - window, 0)
    scored = legs.withColumn("s", spread).withColumn("sd", F.stddev_samp("s").over(back)).withColumn("z", F.when(F.count("s").over(back) >= window, F.try_divide(F.col("s") - F.avg("s").over(back), F.col("sd"))))
    test = scored.where(F.col("i") >= F.col("test_first")).withColumn("y", F.concat_ws("|", F.col("fold").cast("string"), "y"))
    held = pair_positions(test.select("y", "x", "d", F.col("i").cast("int").alias("i"), "ry", "rx", "beta", "z"), rule)
    before = W.partitionBy("y", "x").orderBy("i")
    pos, was = F.col("pos"), F.coalesce(F.lag("pos").over(before), F.lit(0))
    held = held.withColumn("pnl", was * (F.col("ry") - F.col("beta") * F.col("rx")))
    held = held.withColumn("trade", F.abs(pos - was * (1 + F.col("ry"))) + F.abs(-pos * F.col("beta") + was * F.col("beta") * (1 + F.col("rx"))))
    return held.select(F.split("y", "\\|")[0].cast("int").alias("fold"), F.split("y", "\\|")[1].alias("y"), "x", "d", "i", "z", "pos", "pnl", "trade")
