"""Pair and book P&L with drifting legs, costs, capacity, placebo draws and parameter surfaces as SQL."""

from __future__ import annotations

from panelforge.plans.inference import mix

# Capital in dollars, slots, and the cost model's rates, each as its parameter.
CAPITAL, SLOTS = "1e8", "20"
IMPACT, COMMISSION_BPS, FEES_BPS, BORROW_BPS, MAX_PARTICIPATION = "5e-1", "5e-1", "25e-2", "5e1", "1e-1"
# Half-spreads in basis points by average dollar volume.
TIERS = "case when {0} >= 5e8 then 1e0 when {0} >= 1e8 then 15e-1 when {0} >= 25e6 then 25e-1 when {0} >= 0 then 5e0 end"

PANELS = {
    # a lot of the panel's volume is a thousand shares
    "mkt": f"""mkt as (
  select ticker, d, i, r, adv * 1e3 as adv, sigma, {TIERS.format("(adv * 1e3)")} / 1e4 as half from market)""",
}
NEEDS = {"mkt": ["market"]}

#: Weights held through each bar are those of the bar before; a trade is from what they have drifted to.
PNL = """(select *, hy * ry + hx * rx as pnl, abs(pos - hy * (1 + ry)) as trade_y, abs(-pos * beta - hx * (1 + rx)) as trade_x, abs(pos - hy * (1 + ry)) + abs(-pos * beta - hx * (1 + rx)) as trade, abs(pos) * (1 + abs(beta)) as gross
  from (select y, x, d, i, pos, reason, z, ry, rx, beta, coalesce(lag(pos) over w, 0) * 1e0 as hy, coalesce(-lag(pos * beta) over w, 0e0) as hx from st window w as (partition by y, x order by i)) h)"""


def _leg(side: str) -> tuple[str, str, str]:
    """Spread, impact and participation of a leg; null where it trades on undefined market data."""
    t, m = f"p.trade_{side}", f"m{side}"
    part = f"{t} * {CAPITAL} / {SLOTS} / {m}.adv"
    zero = f"case when {t} > 0 then {{0}} else 0e0 end"
    return zero.format(f"{t} * {m}.half"), zero.format(f"{t} * {IMPACT} * {m}.sigma * sqrt({part})"), zero.format(part)


COSTED = f"""(select p.*, {_leg("y")[0]} + {_leg("x")[0]} as cost_spread, {_leg("y")[1]} + {_leg("x")[1]} as cost_impact, greatest({_leg("y")[2]}, {_leg("x")[2]}) as participation,
  p.trade * ({COMMISSION_BPS} + {FEES_BPS}) / 1e4 as cost_commission, (greatest(-p.hy, 0e0) + greatest(-p.hx, 0e0)) * {BORROW_BPS} / 1e4 / 252 as cost_borrow
  from {PNL} p left join mkt my on my.ticker = p.y and my.d = p.d left join mkt mx on mx.ticker = p.x and mx.d = p.d)"""

#: The pairs' daily book on every session: sums over slots.
DAILY = f"""(select c.d, coalesce(sum(pnl), 0e0) / {SLOTS} as pnl, coalesce(sum(cost_spread), 0e0) / {SLOTS} as cost_spread, coalesce(sum(cost_impact), 0e0) / {SLOTS} as cost_impact,
  coalesce(sum(cost_commission), 0e0) / {SLOTS} as cost_commission, coalesce(sum(cost_borrow), 0e0) / {SLOTS} as cost_borrow, coalesce(max(participation), 0e0) as participation,
  coalesce(sum(gross), 0e0) / {SLOTS} as gross, coalesce(sum(trade), 0e0) / {SLOTS} as trade, cast(coalesce(sum(abs(pos)), 0) as int) as n_open, cast(coalesce(sum(case when ry is null or rx is null then 1 else 0 end), 0) as int) as missing
  from cal c left join {COSTED} k on k.d = c.d group by c.d)"""
FIXED = "cost_spread + cost_commission + cost_borrow"
CAPITALS = "(select 1e6 as capital union all select 1e7 union all select 1e8 union all select 1e9 union all select 1e10)"
MULTIPLES = "(select 0e0 as {0} union all select 5e-1 union all select 1e0 union all select 2e0)"

# name: (more panels, select over st)
ON_POSITIONS: dict[str, tuple[list[str], str]] = {
    "pair_pnl": ([], f"select y, x, d, pos, round(pnl, 8) + 0e0 as pnl, round(trade_y, 7) + 0e0 as trade_y, round(trade_x, 7) + 0e0 as trade_x, round(gross, 6) + 0e0 as gross from {PNL} p"),
    "leg_weights": ([], "select y, x, d, pos * 1e0 as w_y, round(-pos * beta, 7) + 0e0 as w_x from st"),
    "pair_costs": (["mkt"], f"""select y, x, d, round(cost_spread, 10) + 0e0 as cost_spread, round(cost_impact, 9) + 0e0 as cost_impact, round(cost_commission, 10) + 0e0 as cost_commission, round(cost_borrow, 10) + 0e0 as cost_borrow,
  round(participation, 8) + 0e0 as participation, participation > {MAX_PARTICIPATION} as breach from {COSTED} k"""),
    "pair_portfolio": (["mkt", "cal"], f"select d, n_open, missing, round(pnl, 8) + 0e0 as pnl, round(gross, 6) + 0e0 as gross, round(trade, 6) + 0e0 as trade, round(pnl - {FIXED} - cost_impact, 8) + 0e0 as net from {DAILY} k"),
    "net_stats": (["mkt", "cal"], f"""select count(*) as n, round(avg(pnl) * 52, 7) as gross_return, round(avg({FIXED} + cost_impact) * 52, 7) as cost, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 5) as net_sharpe,
  round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(52.0), 5) as gross_sharpe, round(avg(trade) * 52, 5) as turnover from (select *, pnl - {FIXED} - cost_impact as net from {DAILY} k) q"""),
    "breakeven_multiple": (["mkt", "cal"], f"select round(case when g <= 0 then 0e0 when c > 0 then g / c else cast('Infinity' as double) end, 6) as multiple from (select avg(pnl) as g, avg({FIXED} + cost_impact) as c from {DAILY} k) q"),
    "net_at_capital": (["mkt", "cal"], f"""select capital, round(avg(pnl - {FIXED} - sqrt(capital / {CAPITAL}) * cost_impact) * 52, 6) + 0e0 as net_return, round(avg(case when participation * capital / {CAPITAL} > {MAX_PARTICIPATION} then 1e0 else 0e0 end), 6) as breach_share
  from {DAILY} k cross join {CAPITALS} c group by capital"""),
    "break_even_capital": (["mkt", "cal"], f"""select round(case when room <= 0 then 0e0 when impact <= 0 then cast('Infinity' as double) else {CAPITAL} * power(room / impact, 2) end, 2) as capital from (select avg(pnl) - avg({FIXED}) as room, avg(cost_impact) as impact from {DAILY} k) q"""),
    "cost_surface": (["mkt", "cal"], f"""select spread_mult, impact_mult, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 5) as net_sharpe from (
  select s.spread_mult, t.impact_mult, pnl - spread_mult * cost_spread - cost_commission - cost_borrow - impact_mult * cost_impact as net from {DAILY} k cross join {MULTIPLES.format("spread_mult")} s cross join {MULTIPLES.format("impact_mult")} t) q group by spread_mult, impact_mult"""),
    "surface_summary": (["mkt", "cal"], f"""select count(*) as cells, round(min(s), 5) as worst, round(max(s), 5) as best, round(PCTL(s, 0.5), 5) as middle, round(avg(case when s > 0 then 1e0 else 0e0 end), 6) as share_positive from (
  select spread_mult, impact_mult, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 7) as s from (
    select s.spread_mult, t.impact_mult, pnl - spread_mult * cost_spread - cost_commission - cost_borrow - impact_mult * cost_impact as net from {DAILY} k cross join {MULTIPLES.format("spread_mult")} s cross join {MULTIPLES.format("impact_mult")} t) q group by spread_mult, impact_mult) z"""),
    # the hedge of an expanding regression as it was when the trade was opened, and a notional for a target volatility then
    "frozen_at_entry": (["pair", "spr"], """select y, x, d, pos, case when pos = 0 then 0e0 else round(first_value(beta) over t, 4) end as beta, case when pos = 0 then 0e0 else coalesce(round(least(3e0, 2e-2 / nullif(first_value(sd) over t, 0)), 4), 0e0) end as notional from (
  select *, sum(case when pos <> old then 1 else 0 end) over (partition by y, x order by i) as trade from (
    select st.y, st.x, st.d, st.i, st.pos, lag(st.pos, 1, 0) over (partition by st.y, st.x order by st.i) as old, e.beta, e.sd from st join (
      select y, x, d, case when n >= 30 and vx > 1e-10 then cxy / vx else 0e0 end as beta, case when m >= 20 then sd end as sd from (
        select p.y, p.x, p.d, count(*) over w as n, avg(p.lx * p.ly) over w - avg(p.lx) over w * avg(p.ly) over w as cxy, avg(p.lx * p.lx) over w - avg(p.lx) over w * avg(p.lx) over w as vx,
          count(s.ret) over v as m, stddev_samp(s.ret) over v as sd from pair p join (select y, x, d, ry - lag(beta) over (partition by y, x order by d) * rx as ret from spr) s on s.y = p.y and s.x = p.x and s.d = p.d
        window w as (partition by p.y, p.x order by p.d rows between unbounded preceding and current row), v as (partition by p.y, p.x order by p.d rows between 19 preceding and current row)) q) e on e.y = st.y and e.x = st.x and e.d = st.d) a) b
  window t as (partition by y, x, trade order by i rows between unbounded preceding and current row)"""),
    # 300 draws of as many pairs as there are slots
    "placebo_series": ([], f"""select b, count(*) as sessions, round(avg(pnl), 9) + 0e0 as mean_pnl, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(52.0), 5) + 0e0 as sharpe from (
  select c.b, p.d, sum(p.pnl) / {SLOTS} as pnl from {PNL} p join (select y, x, b from (
    select y, x, s.k as b, row_number() over (partition by s.k order by {mix("(n * 7919 + s.k * 104729) % 2147483647")}, n) as pick from (select y, x, cast(row_number() over (order by y, x) as bigint) as n from (select distinct y, x from st) u) v cross join SERIES(300) s) q where pick <= {SLOTS}) c
  on c.y = p.y and c.x = p.x group by c.b, p.d) z group by b"""),
}

#: Raw weights by state and volatility, then neutral to the dollar on days with a position; the last row is flat.
RAW = """(select b.ticker, b.d, m.sigma, m.r, case when b.state <> 0 and m.sigma > 0 then b.state * 5e-2 * least(s.med / m.sigma, 3e0) else 0e0 end as raw
  from bs b join market m on m.ticker = b.ticker and m.d = b.d left join (select d, PCTL(sigma, 0.5) as med from market where sigma > 0 group by d) s on s.d = b.d)"""
NEUTRAL = f"""(select ticker, d, case when usable and sum(abs(raw)) over (partition by d) > 0 and d < max(d) over () then raw - avg(case when usable then raw end) over (partition by d) else 0e0 end as w, r
  from (select *, sigma > 0 as usable from {RAW} a) u)"""
CARRIED = f"""(select ticker, d, w, held, r, held * r as pnl, abs(w - held * (1 + r)) as trade from (select *, coalesce(lag(w) over (partition by ticker order by d), 0e0) as held from {NEUTRAL} n) c)"""
BOOK_COSTED = f"""(select c.*, case when trade > 1e-15 then trade * m.half else 0e0 end as cost_spread, case when trade > 1e-15 then trade * {IMPACT} * m.sigma * sqrt(trade * {CAPITAL} / m.adv) else 0e0 end as cost_impact,
  trade * ({COMMISSION_BPS} + {FEES_BPS}) / 1e4 as cost_commission, greatest(-held, 0e0) * {BORROW_BPS} / 1e4 / 252 as cost_borrow, case when trade > 1e-15 then trade * {CAPITAL} / m.adv else 0e0 end as participation
  from {CARRIED} c join mkt m on m.ticker = c.ticker and m.d = c.d)"""

# name: (more panels, select over bs)
ON_STATES: dict[str, tuple[list[str], str]] = {
    "size_book": (["market"], f"select ticker, d, round(raw, 8) + 0e0 as raw from {RAW} a"),
    "book_weights": (["market"], f"select ticker, d, round(w, 8) + 0e0 as w from {NEUTRAL} n"),
    "book_pnl": (["market"], f"select d, round(sum(pnl), 8) + 0e0 as pnl, round(sum(trade), 7) + 0e0 as trade, round(sum(abs(w)), 7) + 0e0 as gross from {CARRIED} c group by d"),
    "book_costs": (["mkt"], f"select d, round(sum(cost_spread), 9) + 0e0 as cost_spread, round(sum(cost_impact), 8) + 0e0 as cost_impact, round(sum(cost_commission), 9) + 0e0 as cost_commission, round(sum(cost_borrow), 9) + 0e0 as cost_borrow, round(max(participation), 7) + 0e0 as participation from {BOOK_COSTED} b group by d"),
    # off the span of a constant and the beta to the market
    "beta_neutral_book": (["market"], f"""select ticker, d, round(case when s > 0 then raw - a - c * beta else 0e0 end, 7) + 0e0 as w from (
  select r.ticker, r.d, r.raw, e.beta, regr_slope(r.raw, e.beta) over p as c, avg(r.raw) over p - regr_slope(r.raw, e.beta) over p * avg(e.beta) over p as a, sum(abs(r.raw)) over p as s from {RAW} r join (
    select ticker, d, round(case when n >= 20 and vx > 1e-14 then cxy / vx end, 6) as beta from (select w.ticker, w.d, count(*) over t as n, avg(w.r * m.r) over t - avg(w.r) over t * avg(m.r) over t as cxy, avg(m.r * m.r) over t - avg(m.r) over t * avg(m.r) over t as vx
      from walk w join (select d, avg(r) as r from walk group by d) m on m.d = w.d window t as (partition by w.ticker order by w.d rows between 19 preceding and current row)) q) e on e.ticker = r.ticker and e.d = r.d
  where e.beta is not null and r.sigma > 0 window p as (partition by r.d)) z"""),
    # a score on the eve of an event is no signal
    "signal_flags": (["market"], """select ticker, d, state, case when event_next then 0 else state end as tradable_state, event_next from (
  select b.ticker, b.d, b.state, coalesce(lead(abs(m.r)) over (partition by b.ticker order by b.d) > 3e-2, false) as event_next from bs b join market m on m.ticker = b.ticker and m.d = b.d) q"""),
    # names that have a volatility on more than half of their days trade places by a hash
    "placebo_permutation": (["market"], f"""select p.other as ticker, b.d, b.state from bs b join (select a.ticker, o.ticker as other from (
    select ticker, row_number() over (order by ticker) as k from (select ticker from market group by ticker having avg(case when sigma > 0 then 1e0 else 0e0 end) > 5e-1) u) a join (
    select ticker, row_number() over (order by {mix("(n * 7919 + 31) % 2147483647")}, n) as k from (select ticker, cast(row_number() over (order by ticker) as bigint) as n from market group by ticker having avg(case when sigma > 0 then 1e0 else 0e0 end) > 5e-1) v) o on o.k = a.k) p on p.ticker = b.ticker"""),
}
SELECTS: dict[str, tuple[list[str], str]] = {
    "half_spread_tiers": (["mkt"], "select ticker, d, round(adv, 0) + 0e0 as adv, half * 1e4 as half_spread_bps from mkt"),
    "folds": (["cal"], """select y as test_year, test_start, test_end, train_start, train_end, sessions, case when test_start < date '1996-01-01' then 'research' when test_start < date '1998-01-01' then 'validation' else 'holdout' end as phase from (
  select a.y, min(a.first_d) as test_start, min(a.last_d) as test_end, min(c.d) as train_start, max(c.d) as train_end, count(*) as sessions from (select year(d) as y, min(d) as first_d, max(d) as last_d from cal group by 1) a join cal c on c.d < a.first_d and year(c.d) >= a.y - 3 group by a.y) f
  where sessions >= 100 and (test_start >= date '1998-01-01' or test_end < date '1998-01-01') and (test_start >= date '1996-01-01' or test_end < date '1996-01-01')"""),
    "expanding_folds": (["cal"], "select a.y as test_year, min(c.d) as train_start, max(c.d) as train_end, count(*) as sessions from (select year(d) as y, min(d) as first_d from cal group by 1) a join cal c on c.d < a.first_d group by a.y having count(*) >= 100"),
}
