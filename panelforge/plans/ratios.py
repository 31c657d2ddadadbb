"""Sharpe ratios under many trials, performance tables and regimes as SQL."""

from __future__ import annotations

from panelforge.functions.normal import cdf, normal_ppf
from panelforge.functions.sharpe import expected_max_z

#: The trials of the strategies, and the effective numbers that a table shows.
TRIALS, EFFECTIVE = 25, (2, 5, 10, 25)
Z95 = f"{normal_ppf(0.975):.15e}"
LEVEL = f"{normal_ppf(0.95):.15e}"
PANELS = {
    "moments": """moments as (
  select o.strategy, o.n, o.m / o.s as sr, avg(power(r - o.m, 3)) / power(avg(power(r - o.m, 2)), 15e-1) as g, avg(power(r - o.m, 4)) / power(avg(power(r - o.m, 2)), 2) as k from ser join obs o on o.strategy = ser.strategy where o.s > 0 group by o.strategy, o.n, o.m, o.s)""",
    "errors": "errors as (select strategy, n, sr, g, k, sqrt((1 - g * sr + (k - 1) / 4 * sr * sr) / (n - 1)) as se, var_samp(sr) over () as v from moments)",
    "trials": "trials as (" + " union all ".join(f"select {n} as trials, {expected_max_z(n):.15e} as z" for n in EFFECTIVE) + ")",
}
NEEDS = {"moments": ["ser", "obs"], "errors": ["moments"], "trials": []}
RATIO = "case when count({0}) > 2 and var_samp({0}) > 0 then avg({0}) / stddev_samp({0}) end"
MARKED = "(select b.strategy, b.i, b.r, case when a.r > 0 then 1 else 0 end as hi from ser a join ser b on b.i = a.i where a.strategy = 0)"


def _difference(r: str = "r") -> str:
    """The Sharpe ratio of the rows with hi = 1 less that of the others."""
    return f"{RATIO.format(f'case when hi = 1 then {r} end')} - {RATIO.format(f'case when hi = 0 then {r} end')}"


SELECTS: dict[str, tuple[list[str], str]] = {
    "probabilistic_sharpe": (["errors"], f"select strategy, round(sr, 6) as sr, round({cdf('(sr / se)')}, 6) as psr from errors"),
    "deflated_sharpe": (["errors", "trials"], f"select strategy, round(sqrt(v) * z, 6) as expected_max, round({cdf('((sr - sqrt(v) * z) / se)')}, 6) as dsr from errors join trials on trials = {TRIALS}"),
    "sharpe_dsr_table": (["errors", "trials"], f"select strategy, trials, round({cdf('((sr - sqrt(v) * z) / se)')}, 6) as dsr from errors cross join trials"),
    "min_track_record": (["moments"], f"select strategy, round(case when sr <= 0 then cast('Infinity' as double) else 1 + (1 - g * sr + (k - 1) / 4 * sr * sr) * power({LEVEL} / sr, 2) end, 2) as periods from moments where abs(sr) > 1e-3"),
    "min_backtest_length": (["trials"], "select trials, round(z, 9) as expected_max_z, round(z * z, 8) as years from trials"),
    "wilson_interval": (["ser"], f"""select strategy, round((p + z * z / (2 * n) - w) / (1 + z * z / n), 6) as low, round((p + z * z / (2 * n) + w) / (1 + z * z / n), 6) as high from (
  select strategy, p, n, {Z95} as z, {Z95} * sqrt(p * (1 - p) / n + {Z95} * {Z95} / (4e0 * n * n)) as w from (select strategy, avg(case when r > 0 then 1e0 else 0e0 end) as p, count(*) as n from ser group by strategy) a) q"""),
    "group_summary": (["ser"], f"""select g, n, hits, round(p, 6) as share, round((p + z * z / (2 * n) - w) / (1 + z * z / n), 6) as low, round((p + z * z / (2 * n) + w) / (1 + z * z / n), 6) as high from (
  select g, n, hits, p, {Z95} as z, {Z95} * sqrt(p * (1 - p) / n + {Z95} * {Z95} / (4e0 * n * n)) as w from (select strategy % 5 as g, count(*) as n, cast(sum(case when r > 0 then 1 else 0 end) as bigint) as hits, avg(case when r > 0 then 1e0 else 0e0 end) as p from ser group by 1) a) q"""),
    "regime_sharpe": (["ser"], f"select strategy, hi, round({RATIO.format('r')} * sqrt(12e0), 6) as sharpe from {MARKED} m group by strategy, hi"),
    "regime_sharpe_difference": (["ser", "pick"], f"""select strategy, round(ob * sqrt(12e0), 6) as difference, round((1e0 + sum(case when abs(db - ob) >= abs(ob) then 1 else 0 end)) / (1e0 + count(db)), 6) as p from (
  select o.strategy, o.ob, e.db from (select strategy, round({_difference()}, 9) as ob from {MARKED} m group by strategy) o join (
    select m.strategy, pick.b, round({_difference()}, 9) as db from pick join {MARKED} m on m.i = pick.pos where pick.b <= 500 group by m.strategy, pick.b) e on e.strategy = o.strategy) q group by strategy, ob"""),
    "equal_volatility": (["ser", "obs"], "select ser.strategy, i, round(r * (select avg(s) from obs) / o.s, 8) + 0e0 as r from ser join obs o on o.strategy = ser.strategy where o.s > 0"),
    "performance_summary": (["walk"], """select p.ticker, n, round(ann, 6) as ann_return, round(vol, 6) as ann_vol, round(dd, 8) as max_drawdown, round(case when dd < 0 then ann / -dd end, 4) as calmar,
  round(case when loss = 0 then case when gain > 0 then cast('Infinity' as double) end else gain / loss end, 5) as profit_factor from (
  select ticker, count(*) as n, avg(r) * 52 as ann, stddev_samp(r) * sqrt(52.0) as vol, sum(greatest(r, 0e0)) as gain, sum(greatest(-r, 0e0)) as loss from walk group by ticker) p join (
  select ticker, min(close / top - 1) as dd from (select ticker, close, greatest(100.0, max(close) over (partition by ticker order by d rows between unbounded preceding and current row)) as top from walk) t group by ticker) m on m.ticker = p.ticker"""),
    "rolling_sharpe": (["walk"], "select ticker, d, case when count(r) over w >= 52 then round(avg(r) over w / nullif(stddev_samp(r) over w, 0) * sqrt(52.0), 5) end as sharpe from walk window w as (partition by ticker order by d rows between 51 preceding and current row)"),
    "drawdown_plot": (["walk"], "select ticker, d, round(100 * (close / greatest(100.0, max(close) over (partition by ticker order by d rows between unbounded preceding and current row)) - 1), 8) + 0e0 as percent from walk"),
    "strategy_matrix": (["ser"], "select i, " + ", ".join(f"round(max(case when strategy = {k} then r end), 8) as s{k}" for k in range(TRIALS)) + " from ser group by i having count(*) = 25"),
    "ou_likelihood": (["walk"], """select ticker, round(-5e-1 * sum(ln(2 * pi() * v) + power(e, 2) / v), 4) as log_likelihood from (
  select f.ticker, case when q.px is null then f.s2 / (1 - f.b * f.b) else f.s2 end as v, case when q.px is null then q.x - f.m else q.x - f.m - f.b * (q.px - f.m) end as e from (
    select ticker, ln(close) as x, lag(ln(close)) over (partition by ticker order by d) as px from walk) q join (
    select ticker, regr_slope(x, px) as b, regr_intercept(x, px) / (1 - regr_slope(x, px)) as m, (regr_syy(x, px) - power(regr_sxy(x, px), 2) / regr_sxx(x, px)) / (count(*) - 2) as s2 from (
      select ticker, ln(close) as x, lag(ln(close)) over (partition by ticker order by d) as px from walk) a where px is not null group by ticker) f on f.ticker = q.ticker where f.b > 0 and f.b < 1) z group by ticker"""),
    "ou_stationary": (["walk"], """select ticker, round(m, 5) as theta, round(sqrt(s2 / (1 - b * b)), 6) as sd, round(sqrt(s2 * -2 * ln(b) * 52 / (1 - b * b)), 5) as sigma from (
  select ticker, regr_slope(x, px) as b, regr_intercept(x, px) / (1 - regr_slope(x, px)) as m, (regr_syy(x, px) - power(regr_sxy(x, px), 2) / regr_sxx(x, px)) / (count(*) - 2) as s2 from (
    select ticker, ln(close) as x, lag(ln(close)) over (partition by ticker order by d) as px from walk) a where px is not null group by ticker) f where b > 0 and b < 99e-2"""),
    # the spread after training, with the hedge and mean of training
    "oos_metrics": (["pair"], """select y, x, round(sd / train_sd, 5) as sd_ratio, round(abs(m) / train_sd, 5) as mean_shift, round(b, 5) as ar1, case when b > 1e-3 and b < 999e-3 then round(-ln(2.0) / ln(b), 3) end as half_life from (
  select y, x, max(train_sd) as train_sd, stddev_samp(s) as sd, avg(s) as m, regr_slope(s, past) as b from (
    select p.y, p.x, h.train_sd, p.ly - h.beta * p.lx - h.alpha as s, lag(p.ly - h.beta * p.lx - h.alpha) over (partition by p.y, p.x order by p.i) as past from pair p join (
      select y, x, regr_slope(ly, lx) as beta, regr_intercept(ly, lx) as alpha, sqrt((regr_syy(ly, lx) - power(regr_sxy(ly, lx), 2) / regr_sxx(ly, lx)) / (count(*) - 1)) as train_sd from pair where d <= date '1996-12-31' group by y, x) h on h.y = p.y and h.x = p.x
    where p.d > date '1996-12-31') q group by y, x) z"""),
    "pair_table_merge": (["pair"], """select a.y, a.x, round(a.beta, 5) as beta_train, round(b.beta, 5) as beta_test, round(a.rho, 5) as rho_train, round(b.rho, 5) as rho_test, a.beta * b.beta > 0 as same_sign from (
  select y, x, regr_slope(ly, lx) as beta, corr(ry, rx) as rho from pair where d <= date '1996-12-31' group by y, x) a left join (select y, x, regr_slope(ly, lx) as beta, corr(ry, rx) as rho from pair where d > date '1996-12-31' group by y, x) b on b.y = a.y and b.x = a.x"""),
    "random_pair_pool": (["pair"], "select y, x, round(beta, 5) as beta from (select y, x, regr_slope(ly, lx) as beta, corr(ry, rx) as rho from pair where d <= date '1996-12-31' group by y, x) q where beta > 0 and rho < 15e-2"),
    "reselect_pairs": (["pair"], """select y, x, round(edge, 5) as edge from (select y, x, edge, row_number() over (order by edge desc, y, x) as k from (
  select y, x, round(1e4 * sqrt(greatest(0e0, regr_syy(ly, lx) - power(regr_sxy(ly, lx), 2) / regr_sxx(ly, lx)) / count(*)), 6) as edge, regr_slope(ly, lx) as beta from pair where d <= date '1996-12-31' group by y, x) q where beta >= 1e-1 and beta <= 1e1) z where k <= 20"""),
    "standardise": (["walk"], "select w.ticker, w.d, round((w.r - f.m) / f.s, 6) + 0e0 as z from walk w join (select ticker, avg(r) as m, stddev_pop(r) as s from walk where d < date '1996-01-01' group by ticker) f on f.ticker = w.ticker where f.s > 0"),
    "hurst_rescaled_range": (["walk"], """select ticker, round(regr_slope(ln(rs), ln(size)), 4) as hurst from (select ticker, size * 1e0 as size, avg((hi - lo) / s) as rs from (
  select ticker, size, chunk, max(c) - least(min(c), 0e0) * 0 as hi, min(c) as lo, max(s) as s from (
    select ticker, size, chunk, s, sum(r - m) over (partition by ticker, size, chunk order by i rows between unbounded preceding and current row) as c from (
      select ticker, size, chunk, i, r, avg(r) over p as m, stddev_pop(r) over p as s, count(*) over p as n from (
        select w.ticker, w.i, w.r, z.size, cast(floor((w.i - 1) / (z.size * 1e0)) as int) as chunk from walk w cross join (select 10 as size union all select 14 union all select 20 union all select 28 union all select 40 union all select 56 union all select 80) z) a
      window p as (partition by ticker, size, chunk)) b where n = size and s > 0) e group by ticker, size, chunk) f group by ticker, size) g where rs > 0 group by ticker"""),
}
