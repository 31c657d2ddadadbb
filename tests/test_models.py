"""Statistical operators against planted cases and brute force."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import leakage, models, screening, statistics, unitroot


def test_p_values_are_those_of_the_critical_values():
    for kind, series, critical in (("n", 1, (-2.566, -1.941, -1.617)), ("c", 1, (-3.43, -2.862, -2.567)), ("ct", 1, (-3.959, -3.41, -3.127)), ("c", 2, (-3.896, -3.336, -3.044))):
        assert [unitroot.p_value(c, kind, series) for c in critical] == pytest.approx([0.01, 0.05, 0.1], abs=0.002)
    assert unitroot.p_value(3, "c") == 1 and unitroot.p_value(-20, "c") == 0 and np.isnan(unitroot.p_value(-2, "ctt"))
    assert unitroot.critical_values(100)[1] == pytest.approx(-2.89, abs=0.005)


def test_adf_by_both_criteria():
    x = np.cumsum(np.random.default_rng(1).normal(size=300))
    assert unitroot.adf_test(x).stat == pytest.approx(statistics.adf(x)[0]) and unitroot.adf_test(x, choose="bic").lag <= unitroot.adf_test(x).lag
    assert unitroot.adf_test(x, max_lag=3, choose=None).lag == 3 and unitroot.adf_test(x).p > 0.05
    assert unitroot.adf_test(np.random.default_rng(2).normal(size=300)).p < 0.001


def test_johansen_ranks_and_vectors():
    rng = np.random.default_rng(3)
    a, b = np.cumsum(rng.normal(size=(2, 800)), axis=1)
    t = unitroot.johansen_test(np.column_stack([a, 2 * a + rng.normal(size=800), b]))
    assert t.rank() == 1 == t.rank(by="largest") and t.vector()[1] == pytest.approx(-0.5, abs=0.02)
    old = statistics.johansen(np.column_stack([a, 2 * a + rng.normal(size=800), b]))[0]
    assert len(old) == 3
    with pytest.raises(ValueError):
        unitroot.johansen_test(np.zeros((50, 2)), 2)
    with pytest.raises(ValueError):
        unitroot.engle_granger_test(a, 2 * a + 1)


def test_ou_by_likelihood():
    x = models.simulate_ou(20, 1.5, 0.4, 4000, 1 / 252, 4)
    fit = models.ou_mle(x, 1 / 252)
    assert fit.kappa == pytest.approx(20, rel=0.3) and fit.theta == pytest.approx(1.5, abs=0.05) and fit.sigma == pytest.approx(0.4, rel=0.05)
    best = models.ou_log_likelihood(x, fit.kappa, fit.theta, fit.sigma, 1 / 252)
    assert best == pytest.approx(fit.log_likelihood)
    for k, t, s in ((1.05, 1, 1), (0.95, 1, 1), (1, 1.01, 1), (1, 1, 1.02), (1, 1, 0.98)):
        assert models.ou_log_likelihood(x, fit.kappa * k, fit.theta * t, fit.sigma * s, 1 / 252) < best
    assert models.hurst_rescaled_range(np.cumsum(np.random.default_rng(5).normal(size=4000))) == pytest.approx(0.55, abs=0.08)


def test_average_linkage_matches_brute_force():
    d = np.abs(np.subtract.outer(x := np.random.default_rng(6).normal(size=9), x))
    for k in (1, 3, 5, 9):
        groups = [{i} for i in range(9)]
        while len(groups) > k:
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: np.mean([d[a, b] for a in groups[p[0]] for b in groups[p[1]]]))
            groups[i] |= groups.pop(j)
        own = models.average_linkage(d, k)
        assert {frozenset(i for i in range(9) if own[i] == c) for c in set(own)} == {frozenset(g) for g in groups}
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(10, 4)))[0]
    assert models.subspace_overlap(q[:, :2], q[:, :2] @ [[1, 1], [0, 2]]) == pytest.approx(1) and models.subspace_overlap(q[:, :2], q[:, 2:]) == pytest.approx(0)
    assert models.factor_space_stability({0: q[:, :2], 1: q[:, :2], 2: q[:, 2:]}, [1]) == {1: pytest.approx(0.5)}


def test_factors_and_hedges():
    r = np.random.default_rng(8).normal(size=(200, 6)) + np.random.default_rng(9).normal(size=(200, 1)) * 2
    fit = models.fit_factors(r)
    assert fit.values.sum() == pytest.approx(6) and fit.beyond_edge() == 1 and fit.explained(6) == pytest.approx(1)
    assert np.allclose(fit.residuals(r, 6), 0) and fit.factor_returns(r, 2).shape == (200, 2)
    with pytest.raises(ValueError):
        models.fit_factors(r[:20])
    assert models.HedgeSpec("rolling", 60).label == "rolling_60"
    with pytest.raises(ValueError):
        models.HedgeSpec("rolling")


def _returns(spark, rows, names, seed=10):
    r = np.random.default_rng(seed).normal(0, 0.01, (rows, len(names)))
    day = datetime.date(2015, 1, 5)
    data = [(n, k % 2, day + datetime.timedelta(weeks=i), i + 1, float(r[i, k])) for k, n in enumerate(names) for i in range(rows)]
    return r, spark.createDataFrame(data, "ticker string, g int, d date, i long, r double")


def test_residual_signals_match_a_plain_loop(spark):
    names = [f"t{k}" for k in range(8)]
    r, df = _returns(spark, 100, names)
    cfg = models.ResidualConfig(factors=2, fit_window=60, refit_every=10, beta_window=30, kappa_min=0.0, year=52)
    got = {(x["ticker"], x["i"]): x for x in models.residual_signals(df.select("ticker", "i", "r"), cfg).collect()}
    assert {i for _, i in got} == set(range(61, 101)) and len(got) == 40 * 8
    for t in (60, 74, 99):
        start = 60 + (t - 60) // 10 * 10
        fit = models.fit_factors(r[start - 60 : start])
        f = fit.factor_returns(r, 2)
        beta = np.linalg.lstsq(f[t - 30 : t], r[t - 30 : t], rcond=None)[0]
        past, now = r[t - 30 : t] - f[t - 30 : t] @ beta, r[t] - f[t] @ beta
        for k, n in enumerate(names):
            assert got[n, t + 1]["eps"] == pytest.approx(now[k], abs=1e-9) and got[n, t + 1]["sigma"] == pytest.approx(np.sqrt((past[:, k] ** 2).sum() / 28), abs=1e-9)


def test_screen_finds_planted_pairs(spark):
    names = [f"t{k}" for k in range(8)]
    r, _ = _returns(spark, 260, names, 11)
    noise = np.diff(models.simulate_ou(40, 0, 0.1, 261, 1 / 52, 12))
    r[:, 2] = 0.9 * r[:, 0] + noise  # t0 and t2 are of one group
    day = datetime.date(2010, 1, 4)
    df = spark.createDataFrame([(0, n, k % 2, i + 1, float(r[i, k])) for k, n in enumerate(names) for i in range(260)], "fold int, ticker string, g int, i long, r double")
    out = screening.screen_pairs(df, screening.ScreenConfig(null_panels=6, max_lag=1)).collect()
    best = min(out, key=lambda x: x["stat"])
    assert (best["y"], best["x"]) == ("t0", "t2") and best["selected"] and best["p"] == min(x["p"] for x in out)
    shifted = screening.shift_panels(df, 2)
    sums = shifted.groupBy("panel", "ticker").agg(F.round(F.sum("r"), 9).alias("s")).collect()
    assert all(len({x["s"] for x in sums if x["ticker"] == n}) == 1 for n in names)
    summary = screening.screen_summary(spark.createDataFrame([(0, 0.01, 1.0), (0, 0.2, 1.0)], "fold int, p double, beta double"), (0.05,)).first()
    assert (summary["n"], summary["discoveries"], summary["fdr"]) == (2, 1, pytest.approx(0.1))


def test_empirical_p(spark):
    rows = [(0, 0, s) for s in (-6.0, -4.0, -3.0, 9.0)] + [(0, 1, s) for s in (-5.0, -3.0, -1.0, 0.0)]
    got = screening.empirical_p(spark.createDataFrame(rows, "fold int, panel int, stat double")).orderBy("stat").collect()
    assert [x["p"] for x in got] == pytest.approx([1 / 5, 2 / 5, 3 / 5, 1])


def test_leakage_is_found(spark):
    _, df = _returns(spark, 40, ["a", "b"])
    past = W.partitionBy("ticker").orderBy("d").rowsBetween(-4, 0)
    honest = lambda x: x.select("ticker", "d", F.avg("r").over(past).alias("v"))
    peeking = lambda x: x.select("ticker", "d", (F.col("r") - F.avg("r").over(W.partitionBy("ticker"))).alias("v"))
    cuts = [datetime.date(2015, 5, 4), datetime.date(2015, 8, 3)]
    leakage.assert_no_lookahead(honest, df, cuts, ["ticker", "d"], "v", ["r"])
    with pytest.raises(AssertionError):
        leakage.assert_no_lookahead(peeking, df, cuts, ["ticker", "d"], "v", ["r"])
    assert leakage.max_difference(df, df.limit(10), ["ticker", "d"], "r") == float("inf")
