"""Panels of prices and returns, and queries on them: one SQL text each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "part", "orders", "events")

# Panels that the queries build on, as common table expressions.
PANELS = {
    "px": """px as (
  select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as d, l_extendedprice / l_quantity as price, l_quantity, l_discount, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join part on l_partkey = p_partkey)""",
    # the first and last price are found before the shuffle, a row for each task and group
    "bar": """bar as (
  select ticker, d, min_by(price, KEY(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open, max(price) as high, min(price) as low,
    max_by(price, KEY(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close, sum(l_quantity) as volume from px group by ticker, d)""",
    "walk": """walk as (
  select ticker, d, r, volume, row_number() over (partition by ticker order by d) as i, 100 * exp(sum(ln(1 + r)) over (partition by ticker order by d rows between unbounded preceding and current row)) as close
  from (select ticker, d, avg(l_discount) - 0.05 as r, sum(l_quantity) as volume from px group by ticker, d) w)""",
    "cal": """cal as (select d, row_number() over (order by d) as seq from (select distinct d from px) c)""",
    "spine": """spine as (
  select t.ticker, cal.d, cal.seq, walk.close, walk.r from cal cross join (select distinct ticker from walk) t left join walk on walk.ticker = t.ticker and walk.d = cal.d)""",
    "mon": """mon as (
  select c_month as d, strategy, (m - avg(m) over ()) / avg(m) over () * 0.05 as r
  from (select cast(date_trunc('month', o_orderdate) as date) as c_month, o_custkey % 25 as strategy, avg(o_totalprice) as m from orders group by 1, 2) q)""",
}
NEEDS = {"px": [], "bar": ["px"], "walk": ["px"], "cal": ["px"], "spine": ["px", "walk", "cal"], "mon": []}
W20 = "over (partition by ticker order by d rows between 19 preceding and current row)"

# name: (panels, select)
SELECTS: dict[str, tuple[list[str], str]] = {
    "bars": (["bar"], "select ticker, d, round(open, 7) as open, round(high, 7) as high, round(low, 7) as low, round(close, 7) as close, volume from bar"),
    "walk": (["walk"], "select ticker, d, round(r, 8) as r, round(close, 6) as close, volume from walk"),
    "coverage": (["spine"], "select ticker, count(*) as sessions, count(close) as observed, round(avg(case when close is null then 0e0 else 1e0 end), 6) as coverage from spine group by ticker"),
    "missing_sessions": (["spine"], "select ticker, d from spine where close is null"),
    "longest_gap": (["spine"], """select ticker, max(n) as longest_gap from (select ticker, g, count(*) as n from (
  select ticker, seq - row_number() over (partition by ticker order by seq) as g from spine where close is null) q group by ticker, g) z group by ticker"""),
    "consecutive_returns": (["spine"], """select ticker, d, round(close / prev - 1, 10) + 0e0 as ret from (
  select ticker, d, close, lag(close) over (partition by ticker order by seq) as prev from spine) q where close is not null and prev is not null"""),
    "ohlc_audit": (["clean"], "select ticker, count(*) as n, cast(sum(case when high < close or low > close then 1 else 0 end) as bigint) as broken, cast(sum(case when volume is null or volume = 0 then 1 else 0 end) as bigint) as no_volume from clean group by ticker"),
    "extreme_moves": (["bar"], """select ticker, d, round(lr, 6) as log_return from (select ticker, d, ln(close / lag(close) over (partition by ticker order by d)) as lr from bar) q where abs(lr) > 2"""),
    "rolling_mean_std": (["walk"], f"""select ticker, d, case when count(close) {W20} >= 20 then round(avg(close) {W20}, 6) end as mean20, case when count(close) {W20} >= 20 then round(stddev_samp(close) {W20}, 6) end as std20 from walk"""),
    "zscore": (["walk"], f"""select ticker, d, case when n >= 20 and s > 0 then round((close - m) / s, 5) end as z from (
  select ticker, d, close, count(close) {W20} as n, avg(close) {W20} as m, stddev_samp(close) {W20} as s from walk) q"""),
    "rolling_beta": (["walk"], f"""select a.ticker, d, case when n >= 20 and vx > 1e-14 then round(cxy / vx, 5) end as beta from (
  select ticker, d, count(*) {W20} as n, avg(x * y) {W20} - avg(x) {W20} * avg(y) {W20} as cxy, avg(x * x) {W20} - avg(x) {W20} * avg(x) {W20} as vx
  from (select w.ticker, w.d, w.r as y, m.r as x from walk w join (select d, avg(r) as r from walk group by d) m on m.d = w.d) p) a"""),
    "rolling_volatility": (["walk"], f"select ticker, d, case when count(r) {W20} >= 20 then round(stddev_samp(r) {W20} * sqrt(52.0), 6) end as vol from walk"),
    "drawdowns": (["walk"], """select ticker, d, round(close / greatest(100.0, max(close) over (partition by ticker order by d rows between unbounded preceding and current row)) - 1, 10) + 0e0 as drawdown from walk"""),
    "drawdown_duration": (["walk"], """select ticker, coalesce(max(n), 0) as duration from (select ticker, g, sum(case when dd < -1e-12 then 1 else 0 end) as n from (
  select ticker, dd, sum(case when dd < -1e-12 then 0 else 1 end) over (partition by ticker order by d rows between unbounded preceding and current row) as g from (
  select ticker, d, close / greatest(100.0, max(close) over (partition by ticker order by d rows between unbounded preceding and current row)) - 1 as dd from walk) a) b group by ticker, g) c group by ticker"""),
    "performance": (["walk"], """select ticker, count(*) as n, round(avg(r) * 10000, 5) as mean_bps, round(avg(r) * 52, 6) as ann_return, round(stddev_samp(r) * sqrt(52.0), 6) as ann_vol,
  round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52.0), 5) as sharpe, round(avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) * sqrt(52.0), 5) as sortino,
  round(sum(case when r > 0 then r else 0 end) / nullif(-sum(case when r < 0 then r else 0 end), 0), 5) as profit_factor,
  round(avg(case when r > 0 then 1e0 when r < 0 then 0e0 end), 6) as hit_rate from walk group by ticker"""),
    "performance_by_year": (["walk"], "select ticker, year(d) as yr, count(*) as n, round(avg(r) * 52, 6) as ann_return, round(stddev_samp(r) * sqrt(52.0), 6) as ann_vol from walk group by ticker, year(d)"),
    "static_hedge": (["walk"], """select a.ticker as y, b.ticker as x, count(*) as n, round(regr_slope(ln(a.close), ln(b.close)), 5) as beta, round(regr_intercept(ln(a.close), ln(b.close)), 5) as alpha
  from walk a join walk b on a.d = b.d and a.ticker < b.ticker where a.d <= date '1996-12-31' group by a.ticker, b.ticker"""),
    "return_correlation": (["walk"], "select a.ticker as a, b.ticker as b, round(corr(a.r, b.r), 6) as rho from walk a join walk b on a.d = b.d and a.ticker < b.ticker group by a.ticker, b.ticker"),
    "top_neighbours": (["walk"], """select distinct least(a, b) as a, greatest(a, b) as b from (select a, b, row_number() over (partition by a order by rho desc, b) as k from (
  select a.ticker as a, b.ticker as b, round(corr(a.r, b.r), 9) as rho from walk a join walk b on a.d = b.d and a.ticker <> b.ticker group by a.ticker, b.ticker) q) z where k <= 3"""),
    "ou_fit": (["walk"], """select ticker, n, round(b, 6) as b, case when bk > 0 and bk < 1 then round(-ln(bk), 4) end as kappa, case when bk > 0 and bk < 1 then round(-ln(2.0) / ln(bk), 3) end as half_life from (
  select ticker, n, b, b + (1 + 3 * b) / (n + 1) as bk from (select ticker, count(x) as n, regr_slope(y, x) as b from (
  select ticker, ln(close) as y, lag(ln(close)) over (partition by ticker order by d) as x from walk) q where x is not null group by ticker) z) o"""),
    "membership_size": (["walk"], """select c.d, count(distinct m.ticker) as members from cal c join (
  select ticker, case when cast(substr(ticker, 7, 2) as int) % 4 = 0 then date '1996-07-01' end as s, case when cast(substr(ticker, 7, 2) as int) % 4 = 1 then date '2000-01-03' end as e from (select distinct ticker from walk) t) m
  on (m.s is null or m.s <= c.d) and (m.e is null or c.d < m.e) group by c.d"""),
    "as_of_dividends": (["walk"], """select ticker, d, round(sum(v), 8) as dividends from (
  select w.ticker, w.d, x.v from (select ticker, d, lag(d) over (partition by ticker order by d) as prev from walk) w
  join (select t.ticker, q.ex, 5e-1 as v from (select distinct ticker from walk) t cross join (select distinct cast(date_trunc('quarter', d) as date) as ex from walk) q) x
  on x.ticker = w.ticker and x.ex <= w.d and (w.prev is null or x.ex > w.prev)) z group by ticker, d"""),
    # a regime is known the session before: above or below the median of all dispersions so far
    "market_regimes": (["walk"], """select d, n, dispersion, case when k > 60 then case when known > med then 'high' else 'low' end end as regime from (
  select d, n, dispersion, lag(dispersion) over (order by d) as known, row_number() over (order by d) as k, PCTL(dispersion, 0.5) over (order by d rows between unbounded preceding and 1 preceding) as med from (
    select d, count(*) as n, round(stddev_samp(r), 7) as dispersion from walk group by d) q) z"""),
    "participation": (["market"], "select ticker, round(PCTL(share, 0.5), 7) as median_share, round(PCTL(share, 0.95), 7) as p95_share, round(avg(case when share > 1e-1 then 1e0 else 0e0 end), 6) as breach_share from (select ticker, 1e4 / adv as share from market where adv > 0) q group by ticker"),
    "monthly_strategies": (["mon"], "select strategy, count(*) as n, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12.0), 5) as sharpe, round(avg(r) * 10000, 5) as mean_bps from mon group by strategy"),
    "empirical_p_values": (["mon"], """select a.strategy, round((1e0 + sum(case when b.m >= a.m then 1 else 0 end)) / (1e0 + count(*)), 6) as p from
  (select strategy, avg(r) as m from mon group by strategy) a join (select strategy, avg(r) as m from mon group by strategy) b on a.strategy <> b.strategy group by a.strategy"""),
    "episodes": (["walk"], """select ticker, up, count(*) as runs, round(PCTL(n, 0.5), 4) as middle, max(n) as longest from (select ticker, up, g, count(*) as n from (
  select ticker, up, i - row_number() over (partition by ticker, up order by i) as g from (select ticker, i, case when r > 0 then 1 else 0 end as up from walk) a) b group by ticker, up, g) c group by ticker, up"""),
    "hourly_events": ([], "select event_type, date_trunc('hour', ts) as h, count(*) as n, round(avg(value), 6) as mean_value, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1, 2"),
}
SELECTS["membership_size"][0].append("cal")


def run_sql(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """SQL passthrough: any query over the tables of a data directory."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)
