"""Panel queries against DuckDB, kernels and state machines against hand-worked or brute-force values."""

import math

import duckdb
import numpy as np
import pytest

from panelforge.operators import states, statistics
from panelforge.plans import catalog, panel

SF = "/root/testdata/sf0.001"
NAMES = ["coverage", "zscore", "ou_fit", "performance", "as_of_dividends", "episodes", "keep_last", "total_return", "corwin_schultz", "engle_granger_lag0", "pair_trades", "book_states", "romano_wolf", "spa_test", "cscv_pbo", "spearman"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    c = duckdb.connect()
    for t in panel.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = c.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def clean(v):
        return None if v is None or v != v else round(v, 4) + 0.0 if isinstance(v, float) else str(v)

    a = sorted(([clean(r[c]) for c in cols] for r in got.collect()), key=str)
    b = sorted(([clean(v) for v in r] for r in want.select(*cols).fetchall()), key=str)
    assert a == b


def test_shift_test_is_the_one_of_numpy(spark):
    rows = panel.run_sql(spark, SF, catalog.text(["ser"], "select strategy, i, r from ser", "spark")).collect()
    series: dict = {}
    for r in rows:
        series.setdefault(r["strategy"], {})[r["i"]] = float(r["r"])
    n = max(r["i"] for r in rows)
    got = {r["strategy"]: r for r in catalog.QUERIES["shift_test"](spark, SF).collect()}
    assert set(got) == set(series) and len(series) > 2

    def difference(own, shift):
        pairs = [(own[j], x > 0) for i, x in series[0].items() if (j := (i + shift - 1) % n + 1) in own]
        a, b = (np.array([r for r, hi in pairs if hi == state]) for state in (True, False))
        return round(math.sqrt(12) * (a.mean() / a.std(ddof=1) - b.mean() / b.std(ddof=1)), 9)

    for s, own in series.items():
        ob, null = difference(own, 0), [difference(own, k) for k in range(1, n)]
        assert got[s]["shifts"] == n - 1 and got[s]["difference"] == pytest.approx(ob, abs=1e-5)
        assert got[s]["p"] == pytest.approx((1 + sum(abs(x) >= abs(ob) for x in null)) / n, abs=1e-6)
    c = duckdb.connect()
    for t in panel.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for s, d, p, k in c.sql(catalog.ORACLES["shift_test"]).select("strategy", "difference", "p", "shifts").fetchall():
        assert got[s]["shifts"] == k and got[s]["p"] == pytest.approx(p, abs=1e-6) and got[s]["difference"] == pytest.approx(d, abs=1e-5)


def test_pair_machine():
    rule = states.PairRule(entry=1.5, exit=0.5, stop=3.0, max_hold=3)
    positions, reasons = states.walk_pair([2, 1, 0.4, -2, -3.5, -2, 0, -2, None, 2, 2, 2, 2, 2], rule)
    assert positions == [-1, -1, 0, 1, 0, 0, 0, 1, 0, -1, -1, -1, 0, 0]
    assert [r for r in reasons if r] == [states.MEAN, states.STOP, states.DATA, states.TIME]
    with pytest.raises(ValueError):
        states.PairRule(entry=0.5, exit=0.5)


def test_book_machine():
    walk = lambda z: states.walk_book(z, 1.25, 0.5, 4.0, 60)
    assert walk([2, 1, -2, -2, 0]) == [-1, -1, 1, 1, 0]
    assert walk([2, 5, 2, None, 2, 2]) == [-1, 0, 0, 0, -1, 0]


def test_adf_without_lags_is_a_regression():
    x = np.cumsum(np.random.default_rng(1).normal(size=200))
    design = np.column_stack([x[:-1], np.ones(199)])
    beta, rss, *_ = np.linalg.lstsq(design, np.diff(x), rcond=None)
    se = math.sqrt(rss[0] / 197 * np.linalg.inv(design.T @ design)[0, 0])
    assert statistics.adf(x, "c", 0)[0] == pytest.approx(beta[0] / se)


def test_tests_find_what_is_planted():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=500))
    y = 2 * x + rng.normal(size=500)
    stat, _, beta = statistics.engle_granger(y, x)
    assert stat < -5 and beta == pytest.approx(2, abs=0.1)
    trace, most = statistics.johansen(np.column_stack([x, y]))
    assert trace[0] > 20 > trace[1] and most[1] == pytest.approx(trace[1])
    hedge = statistics.kalman(y, x)
    assert np.isnan(hedge[59, 0]) and hedge[-1, 0] == pytest.approx(2, abs=0.3)


def test_pca_keeps_the_trace():
    corr = np.corrcoef(np.random.default_rng(3).normal(size=(8, 100)))
    values, vectors = statistics.pca(corr)
    assert values.sum() == pytest.approx(8) and np.allclose(vectors @ np.diag(values) @ vectors.T, corr)
