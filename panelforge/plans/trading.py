"""Pairs, positions, trades, costs and books as SQL; positions come from the state machines of operators.states."""

from __future__ import annotations

from panelforge.operators.states import PairRule

RULE = PairRule()
SECTOR = "(cast(substr({0}, 7, 2) as int) - 1) % 5"
BACK20 = "over (partition by y, x order by d rows between 19 preceding and current row)"
PAST = "over (partition by ticker order by d rows between 20 preceding and 1 preceding)"

PANELS = {
    "pair": f"""pair as (
  select a.ticker as y, b.ticker as x, a.d, cast(row_number() over (partition by a.ticker, b.ticker order by a.d) as int) as i, ln(a.close) as ly, ln(b.close) as lx, a.r as ry, b.r as rx
  from walk a join walk b on a.d = b.d and a.ticker < b.ticker and {SECTOR.format("a.ticker")} = {SECTOR.format("b.ticker")})""",
    "spr": """spr as (
  select p.y, p.x, p.d, p.i, p.ry, p.rx, h.beta, p.ly - h.beta * p.lx - h.alpha as spread from pair p join (
    select y, x, regr_slope(ly, lx) as beta, regr_intercept(ly, lx) as alpha from pair where d <= date '1996-12-31' group by y, x) h on h.y = p.y and h.x = p.x)""",
    "zs": f"""zs as (
  select y, x, d, i, ry, rx, beta, case when n >= 20 and s > 1e-9 then round((spread - m) / s, 5) end as z from (
    select y, x, d, i, ry, rx, beta, spread, count(spread) {BACK20} as n, avg(spread) {BACK20} as m, stddev_samp(spread) {BACK20} as s from spr) q)""",
    "score": """score as (
  select ticker, d, cast(i as int) as i, case when n >= 20 and s > 1e-9 then round((close - m) / s, 5) end as z from (
    select ticker, d, i, close, count(close) over w as n, avg(close) over w as m, stddev_samp(close) over w as s from walk
    window w as (partition by ticker order by d rows between 19 preceding and current row)) q)""",
    "market": f"""market as (
  select ticker, d, i, r, close, volume, case when count(*) {PAST} >= 10 then PCTL(close * volume, 0.5) {PAST} end as adv,
    case when count(*) {PAST} >= 10 then stddev_samp(r) {PAST} end as sigma from walk)""",
}
NEEDS = {"pair": ["walk"], "spr": ["pair"], "zs": ["spr"], "score": ["walk"], "market": ["walk"]}

#: The positions again, as a recursion that other engines run.
POSITIONS_CHECK = f"""st as (
  select y, x, d, i, ry, rx, beta, z, 0 as pos, 0 as held, false as bp, false as bm, 0 as reason from zs where i = 1
  union all
  select y, x, d, i, ry, rx, beta, z,
    case when why > 0 then 0 when p <> 0 then p when z > {RULE.entry} and z < {RULE.stop} and not cm then -1 when z < -{RULE.entry} and z > -{RULE.stop} and not cp then 1 else 0 end as pos,
    case when p <> 0 then h else 0 end as held, cp or (why in (2, 3) and p = 1) as bp, cm or (why in (2, 3) and p = -1) as bm, why as reason
  from (select *, case when p = 0 then 0 when z is null then 4 when -p * z >= {RULE.stop} then 2 when -p * z <= {RULE.exit} then 1 when h >= {RULE.max_hold} then 3 else 0 end as why
    from (select n.y, n.x, n.d, n.i, n.ry, n.rx, n.beta, n.z, s.pos as p, s.held + 1 as h,
      s.bp and not coalesce(abs(n.z) <= {RULE.exit}, false) as cp, s.bm and not coalesce(abs(n.z) <= {RULE.exit}, false) as cm
      from st s join zs n on n.y = s.y and n.x = s.x and n.i = s.i + 1) a) b)"""

STATES_CHECK = """last as (select ticker, max(i) as m from score group by ticker),
br as (
  select ticker, d, i, z, 0 as state, 0 as held, false as barred from score where i = 1
  union all
  select ticker, d, i, z, case when s <> 0 then s when z is null or b then 0 when z > 1.25 and z < 4 then -1 when z < -1.25 and z > -4 then 1 else 0 end, case when s <> 0 then h else 0 end, b
  from (select *, case when p = 0 or z is null or late or -p * z < 0.5 then 0 else p end as s, (barred or (p <> 0 and z is not null and late)) and not abs(coalesce(z, 0)) < 0.5 as b
    from (select n.ticker, n.d, n.i, n.z, q.state as p, q.held + 1 as h, q.barred, coalesce(-q.state * n.z > 4, false) or q.held + 1 >= 60 as late
      from br q join score n on n.ticker = q.ticker and n.i = q.i + 1) a) c),
bs as (select br.ticker, d, case when i = m then 0 else state end as state from br join last on last.ticker = br.ticker)"""

PNL = """(select y, x, i, coalesce(lag(pos) over w * (ry - beta * rx), 0e0) as pnl from st window w as (partition by y, x order by i))"""

# name: (more panels, select over st)
ON_POSITIONS: dict[str, tuple[list[str], str]] = {
    "pair_positions": ([], "select y, x, d, z, pos, reason from st"),
    "pair_trades": ([], f"""select t.y, t.x, t.d as entry, e.d as leave, t.pos as direction, coalesce(e.reason, 5) as reason, cast(coalesce(e.i, t.n) - t.i as int) as bars, round(t.z, 5) as entry_z, round(sum(p.pnl), 7) + 0e0 as pnl
  from (select *, lead(i) over (partition by y, x order by i) as nxt from (select y, x, d, i, z, pos, lag(pos, 1, 0) over w as old, max(i) over (partition by y, x) as n from st window w as (partition by y, x order by i)) a where pos <> old) t
  left join st e on e.y = t.y and e.x = t.x and e.i = t.nxt and e.pos <> t.pos
  left join {PNL} p on p.y = t.y and p.x = t.x and p.i > t.i and p.i <= coalesce(e.i, t.n) where t.pos <> 0
  group by t.y, t.x, t.d, e.d, t.pos, e.reason, e.i, t.n, t.i, t.z"""),
    "exit_reasons": ([], "select reason, count(*) as n from st where reason > 0 group by reason"),
}

SELECTS: dict[str, tuple[list[str], str]] = {
    "pair_zscore": (["zs"], "select y, x, d, z from zs"),
    "spread_returns": (["spr"], "select y, x, d, round(ry - lag(beta) over (partition by y, x order by d) * rx, 8) + 0e0 as ret from spr"),
    "expanding_hedge": (["pair"], """select y, x, d, case when n >= 30 and vx > 1e-10 then round(cxy / vx, 4) end as beta from (
  select y, x, d, count(*) over w as n, avg(lx * ly) over w - avg(lx) over w * avg(ly) over w as cxy, avg(lx * lx) over w - avg(lx) over w * avg(lx) over w as vx from pair window w as (partition by y, x order by d rows between unbounded preceding and current row)) q"""),
    "ewm_mean_std": (["walk"], """select ticker, d, case when i >= 5 then round(sx / s, 6) end as mean, case when i >= 5 then round(sqrt(greatest(sxx / s - sx / s * sx / s, 0e0) * s * s / (s * s - s2)), 4) end as std from (
  select ticker, d, i, sum(g) over w as s, sum(g * g) over w as s2, sum(g * x) over w as sx, sum(g * x * x) over w as sxx from (
  select ticker, d, i, close - 100 as x, exp((i - max(i) over (partition by ticker)) * ln(2e0) / 20) as g from walk) a window w as (partition by ticker order by d rows between unbounded preceding and current row)) q"""),
    "market_data": (["market"], "select ticker, d, round(adv, 3) as adv, round(sigma, 8) as sigma from market"),
    # ranges are shifted by what the session opened beyond the last close
    "corwin_schultz": (["bar"], """select ticker, d, case when b is not null then round(2 * (exp(a) - 1) / (1 + exp(a)), 7) end as spread from (
  select ticker, d, b, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2e0)) - sqrt(g / (3 - 2 * sqrt(2e0))) as a from (
  select ticker, d, v + lag(v) over w as b, power(ln(greatest(h, lag(h) over w) / least(l, lag(l) over w)), 2) as g from (
  select ticker, d, h, l, power(ln(h / l), 2) as v from (select ticker, d, high + shift as h, low + shift as l from (
    select ticker, d, high, low, coalesce(greatest(prev - high, 0e0) - greatest(low - prev, 0e0), 0e0) as shift from (select ticker, d, high + 0e0 as high, low + 0e0 as low, lag(close) over (partition by ticker order by d) as prev from bar) o) s) a) c window w as (partition by ticker order by d)) e) f"""),
    "rolling_beta_guarded": (["walk"], """select ticker, d, case when n >= 20 and vx > 1e-12 * greatest(mx, 1e-300) then round(cxy / vx, 5) end as beta from (
  select a.ticker, a.d, count(*) over w as n, avg(a.r * m.r) over w - avg(a.r) over w * avg(m.r) over w as cxy, avg(m.r * m.r) over w - avg(m.r) over w * avg(m.r) over w as vx, avg(m.r * m.r) over w as mx
  from walk a join (select d, avg(r) as r from walk group by d) m on m.d = a.d window w as (partition by a.ticker order by a.d rows between 19 preceding and current row)) q"""),
    "expanding_mean_std": (["walk"], "select ticker, d, case when count(close) over w >= 20 then round(avg(close) over w, 6) end as mean, case when count(close) over w >= 20 then round(stddev_samp(close) over w, 6) end as std from walk window w as (partition by ticker order by d rows between unbounded preceding and current row)"),
    "rolling_hedge": (["pair"], """select y, x, d, case when n >= 60 and vx > 1e-10 then round(cxy / vx, 4) end as beta from (
  select y, x, d, count(*) over w as n, avg(lx * ly) over w - avg(lx) over w * avg(ly) over w as cxy, avg(lx * lx) over w - avg(lx) over w * avg(lx) over w as vx from pair window w as (partition by y, x order by d rows between 59 preceding and current row)) q"""),
    "hurst_variance": (["walk"], """select ticker, round(regr_slope(ln(s), ln(t)), 4) as hurst from (
  select a.ticker, s.k * 1e0 as t, stddev_samp(ln(b.close) - ln(a.close)) as s from walk a cross join SERIES(20) s join walk b on b.ticker = a.ticker and b.i = a.i + s.k where s.k >= 2 group by a.ticker, s.k) q where s > 0 group by ticker"""),
    "adf_lag0": (["walk"], """select ticker, n, round(b / se, 4) as stat from (
  select ticker, n, b, sqrt((syy - b * b * sxx) / (n - 2) / sxx) as se from (
  select ticker, count(*) as n, regr_slope(y, x) as b, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy from (
  select ticker, ln(close) - lag(ln(close)) over w as y, lag(ln(close)) over w as x from walk window w as (partition by ticker order by d)) a where x is not null group by ticker) c) e"""),
    "engle_granger_lag0": (["pair"], """select y, x, round(b / sqrt((dd - b * b * ee) / (n - 1) / ee), 4) as stat from (
  select y, x, count(*) as n, sum(de * e) / sum(e * e) as b, sum(e * e) as ee, sum(de * de) as dd from (
  select y, x, lag(e) over w as e, e - lag(e) over w as de from (select p.y, p.x, p.i, ly - a - b * lx as e from pair p join (
  select y, x, regr_slope(ly, lx) as b, regr_intercept(ly, lx) as a from pair group by y, x) h on h.y = p.y and h.x = p.x) r window w as (partition by y, x order by i)) q where e is not null group by y, x) z"""),
    "mean_break": (["walk"], """select ticker, d, round(f, 3) as sup_f from (select ticker, d, f, row_number() over (partition by ticker order by f desc, d) as k from (
  select ticker, d, (n - 2) * ssb / (tot - ssb) as f from (select ticker, d, n, i, tot, power(c - i * m, 2) * n / (i * 1e0 * (n - i)) as ssb from (
  select ticker, d, i, count(*) over p as n, avg(r) over p as m, sum(r) over (partition by ticker order by d rows between unbounded preceding and current row) as c, var_samp(r) over p * (count(*) over p - 1) as tot
  from walk window p as (partition by ticker)) a where i >= 15e-2 * n and i <= 85e-2 * n) b) c) e where k = 1"""),
    "neutral_book": (["score"], "select ticker, d, round(w - avg(w) over (partition by d), 8) + 0e0 as w from (select ticker, d, case when z > 1.25 then -1e0 when z < -1.25 then 1e0 else 0e0 end as w from score where z is not null) q"),
    "size_weights": (["market"], "select m.ticker, m.d, round(least(s.med / m.sigma, 3), 6) as mult from market m join (select d, PCTL(sigma, 0.5) as med from market where sigma > 0 group by d) s on s.d = m.d where m.sigma > 0"),
    "blackout": (["walk"], "select ticker, d, max(case when abs(r) > 25e-3 then 1 else 0 end) over (partition by ticker order by d rows between 2 preceding and 1 following) as blocked from walk"),
    "expanding_above_median": (["market"], "select ticker, d, case when k >= 40 then case when sigma > med then 1 else 0 end end as high from (select ticker, d, sigma, count(sigma) over w as k, round(PCTL(sigma, 0.5) over w, 9) as med from (select ticker, d, round(sigma, 9) as sigma from market) m where sigma is not null window w as (partition by ticker order by d rows between unbounded preceding and current row)) q"),
    "correlation_distance": (["walk"], "select a.ticker as a, b.ticker as b, round(sqrt(greatest(0e0, (1 - corr(a.r, b.r)) / 2)), 6) as dist from walk a join walk b on a.d = b.d and a.ticker < b.ticker group by a.ticker, b.ticker"),
}
