"""All panel queries by name: texts put together from shared tables, planned by Spark and checked by another SQL engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from panelforge.operators import states, statistics
from panelforge.plans import books, cleaning, inference, kernels, panel, ratios, trading

MODULES = (panel, cleaning, trading, inference, books, ratios)
ON_POSITIONS = trading.ON_POSITIONS | books.ON_POSITIONS
KERNELS = statistics.QUERIES | kernels.QUERIES
PANELS = {n: t for m in MODULES for n, t in m.PANELS.items()}
NEEDS = {n: t for m in MODULES for n, t in m.NEEDS.items()}
SELECTS = {n: t for m in MODULES for n, t in m.SELECTS.items()}

#: The few spellings that differ between the engines: SERIES(n) has rows k = 1..n, PCTL(x, p) is the linear quantile, KEY(a, b) a row that is ordered by a, then b.
SPELLINGS = {
    "spark": [(r"SERIES\((\w+)\)", r"(select explode(sequence(bigint(1), bigint(\1))) as k)"), (r"PCTL\(", "percentile("), (r"KEY\(", "struct(")],
    "check": [(r"SERIES\((\w+)\)", r"(select unnest(generate_series(1, \1)) as k)"), (r"PCTL\(", "quantile_cont("), (r"KEY\(", "row(")],
}


def ordered(names: list[str]) -> list[str]:
    """The panels that the named ones need, each after those it needs itself."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*ordered(NEEDS[n]), n] if x not in out]
    return out


def text(names: list[str], select: str, engine: str, word: str = "with", extra: tuple[str, ...] = ()) -> str:
    """One statement: the named panels, more tables, the select."""
    parts = [PANELS[n] for n in ordered(names)] + list(extra)
    whole = (f"{word} " + ",\n".join(parts) + "\n" if parts else "") + select
    for found, spelled in SPELLINGS[engine]:
        whole = re.sub(found, spelled, whole)
    return whole


def _plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return panel.run_sql(spark, sf_dir, text(*SELECTS[name], "spark"))


def _positions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Queries on positions: scores in SQL, positions by the state machine, the rest in SQL."""
    scores = panel.run_sql(spark, sf_dir, text(["zs"], "select * from zs", "spark"))
    states.pair_positions(scores).createOrReplaceTempView("st")
    return spark.sql(text(*ON_POSITIONS[name], "spark"))


def _on_states(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Queries on the book's states: scores in SQL, states by the state machine, the rest in SQL."""
    scores = panel.run_sql(spark, sf_dir, text(["score"], "select * from score", "spark"))
    states.score_states(scores).select("ticker", "d", "state").createOrReplaceTempView("bs")
    return spark.sql(text(*books.ON_STATES[name], "spark"))


def _book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = panel.run_sql(spark, sf_dir, text(["score"], "select * from score", "spark"))
    return states.score_states(scores).select("ticker", "d", "state")


def _kernel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names, select, kernel = KERNELS[name]
    return kernel(panel.run_sql(spark, sf_dir, text(names, select, "spark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(_plain, name=n) for n in SELECTS}
QUERIES |= {n: partial(_positions, name=n) for n in ON_POSITIONS}
QUERIES |= {n: partial(_on_states, name=n) for n in books.ON_STATES}
QUERIES |= {"book_states": _book_states}
QUERIES |= {n: partial(_kernel, name=n) for n in KERNELS}

ORACLES: dict[str, str] = {n: text(*SELECTS[n], "check") for n in SELECTS}
ORACLES |= {n: text(["zs", *more], s, "check", "with recursive", (trading.POSITIONS_CHECK,)) for n, (more, s) in ON_POSITIONS.items()}
ORACLES |= {n: text(["score", *more], s, "check", "with recursive", (trading.STATES_CHECK,)) for n, (more, s) in books.ON_STATES.items()}
ORACLES["book_states"] = text(["score"], "select ticker, d, state from bs", "check", "with recursive", (trading.STATES_CHECK,))
ORACLES["kalman_hedge"] = text(["pair"], kernels.KALMAN_SELECT, "check", "with recursive", (kernels.KALMAN_CHECK,))
