"""Hand vectors of P&L, costs and Sharpe statistics."""

import datetime
import math

import numpy as np
import pytest

from panelforge.functions import normal, sharpe
from panelforge.plans import books, catalog


@pytest.fixture()
def positions(spark):
    ry, rx = [0.0, 0.01, 0.02, -0.01, 0.03], [0.0, 0.0, 0.01, 0.01, 0.01]
    rows = [("Y", "X", datetime.date(2020, 1, 1 + k), k + 1, ry[k], rx[k], 0.5, None, p, 0) for k, p in enumerate([0, 1, 1, 0, 0])]
    spark.createDataFrame(rows, "y string, x string, d date, i int, ry double, rx double, beta double, z double, pos int, reason int").createOrReplaceTempView("st")


def test_pair_pnl_drifts(spark, positions):
    rows = spark.sql(f"select * from {books.PNL} p order by i").collect()
    assert [r["pnl"] for r in rows] == pytest.approx([0, 0, 0.015, -0.015, 0])
    assert [r["trade"] for r in rows] == pytest.approx([0, 1.5, 0.02 + 0.005, 0.99 + 0.505, 0])


def test_turnover_is_from_what_weights_have_drifted_to(spark):
    rows = [("Y", "X", datetime.date(2020, 1, 1 + k), k + 1, r, 0.0, 0.5, None, p, 0) for k, (r, p) in enumerate(zip([0.0, 0.0, 0.1, 0.0], [0, 1, 1, 0]))]
    spark.createDataFrame(rows, "y string, x string, d date, i int, ry double, rx double, beta double, z double, pos int, reason int").createOrReplaceTempView("st")
    assert [r["trade"] for r in spark.sql(f"select * from {books.PNL} p order by i").collect()] == pytest.approx([0, 1.5, 0.1, 1.5])


def test_costs_of_a_day(spark, positions):
    rows = [(t, datetime.date(2020, 1, 1 + k), 1e8, 0.02, 2e-4) for t in "YX" for k in range(5)]
    spark.createDataFrame(rows, "ticker string, d date, adv double, sigma double, half double").createOrReplaceTempView("mkt")
    day = spark.sql(f"select * from {books.COSTED} c order by i").collect()[1]
    slot = 1e8 / 20
    assert day["cost_spread"] == pytest.approx(1.5 * 2e-4) and day["cost_commission"] == pytest.approx(1.5 * 0.75 / 1e4)
    assert day["cost_impact"] == pytest.approx(0.5 * 0.02 * (math.sqrt(slot / 1e8) + 0.5 * math.sqrt(0.5 * slot / 1e8)))
    assert day["participation"] == pytest.approx(0.05) and day["cost_borrow"] == 0
    third = spark.sql(f"select * from {books.COSTED} c order by i").collect()[2]
    assert third["cost_borrow"] == pytest.approx(0.5 * 50 / 1e4 / 252)


def test_tiers(spark):
    adv = [6e8, 5e8, 2e8, 1e8, 5e7, 2.5e7, 1e6, None]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(adv)], "k int, adv double").selectExpr("k", f"{books.TIERS.format('adv')} as t").orderBy("k").collect()
    assert [r["t"] for r in rows] == [1, 1, 1.5, 1.5, 2.5, 2.5, 5, None]


def test_normal_is_that_of_the_library(spark):
    z, p = np.linspace(-6.9, 6.9, 60), np.r_[1e-7, 0.01, 0.0242, 0.0243, np.linspace(0.05, 0.95, 19), 0.9757, 0.9758, 1 - 1e-7]
    got = spark.createDataFrame([(float(x),) for x in z], "z double").selectExpr("z", f"{normal.cdf('z')} as p").collect()
    assert all(r["p"] == pytest.approx(normal.normal_cdf(r["z"]), abs=1e-13) for r in got)
    got = spark.createDataFrame([(float(x),) for x in p], "p double").selectExpr("p", f"{normal.ppf('p')} as z").collect()
    assert all(r["z"] == pytest.approx(normal.normal_ppf(r["p"]), rel=2e-8, abs=1e-8) for r in got)


def test_sharpe_closed_forms():
    assert sharpe.psr(0.0, 100) == pytest.approx(0.5) and sharpe.psr(0.2, 101) == pytest.approx(normal.normal_cdf(0.2 * 10 / math.sqrt(1.02)))
    n = sharpe.min_track_record(0.1)
    assert sharpe.psr(0.1, math.ceil(n)) >= 0.95 > sharpe.psr(0.1, math.floor(n) - 1) and math.isinf(sharpe.min_track_record(0.0))
    assert sharpe.expected_max_z(1) == 0 and sharpe.expected_max_z(10) == pytest.approx(1.5746, abs=1e-3)
    draws = np.random.default_rng(0).normal(size=(20_000, 10)).max(1).mean()
    assert sharpe.expected_max_z(10) == pytest.approx(draws, abs=0.05)
    assert sharpe.dsr(0.2, 200, 0, 3, 0.01, 10) < sharpe.psr(0.2, 200) and sharpe.min_backtest_length(10, 0.5) == pytest.approx(4 * sharpe.expected_max_z(10) ** 2)
    assert [sharpe.money(x) for x in (2.3e6, 247_000, 3.1e9, 12)] == ["$2.30M", "$247K", "$3.10B", "$12"]


def test_catalog_has_sql_for_all_but_kernels():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(catalog.KERNELS) - {"kalman_hedge"}
