"""Cleaning, identity, membership, splits and refresh as SQL."""

from __future__ import annotations

PANELS = {
    "hourly": """hourly as (
  select event_type as ticker, date_trunc('hour', ts) as h, value, event_id, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts desc, event_id desc) as k from events)""",
    "splits": "splits as (select distinct ticker, date '1998-06-01' as ex, 2e0 as f from bar where cast(substr(ticker, 7, 2) as int) % 7 = 0)",
    "divs": """divs as (
  select ticker, d, close * 1e-2 as v from (select ticker, d, close, row_number() over (partition by ticker, date_trunc('quarter', d) order by d) as k from walk where cast(substr(ticker, 7, 2) as int) % 2 = 1) q where k = 1)""",
    "member": """member as (
  select ticker, case when cast(substr(ticker, 7, 2) as int) % 4 = 0 then date '1996-07-01' end as s, case when cast(substr(ticker, 7, 2) as int) % 4 = 1 then date '2000-01-03' end as e from (select distinct ticker from px) t)""",
    "growth": """growth as (
  select w.ticker, w.d, w.close, exp(sum(ln(1 + coalesce(v.v, 0) / w.close)) over (partition by w.ticker order by w.d rows between unbounded preceding and current row)) as g from walk w left join divs v on v.ticker = w.ticker and v.d = w.d)""",
}
PANELS |= {
    # planted inputs, by the number of the brand: what a vendor sends, with its faults, and what a store says of each ticker
    "num": "num as (select ticker, cast(substr(ticker, 7, 2) as int) as b, min(d) as first_d, max(d) as last_d, count(*) as n from walk group by ticker)",
    "vendor": """vendor as (
  select w.ticker, w.d, 0 as arrival, case when b % 5 = 1 and i % 50 = 0 then -close when b % 5 = 2 and i % 50 = 0 then null else close end as close, case when b % 5 = 3 and i % 40 = 0 then -volume else volume end as volume,
    case when b % 5 = 4 and i % 30 = 0 then null else close * 99e-2 end as low, case when b % 7 = 1 and i % 60 = 0 then close * 98e-2 else close * 101e-2 end as high from walk w join num on num.ticker = w.ticker
  union all select w.ticker, w.d, 1, close * 1001e-3, volume, close * 99e-2, close * 102e-2 from walk w join num on num.ticker = w.ticker where i % 25 = 0 and b % 2 = 0)""",
    "clean": """clean as (
  select ticker, d, close, case when volume < 0 then null else volume end as volume, low, high from (select *, row_number() over (partition by ticker, d order by arrival desc) as k from vendor) q where k = 1 and close > 0)""",
    "restated": """restated as (
  select w.ticker, w.d, case when b % 6 = 0 and d >= date '1997-01-06' then close * 102e-2 when b % 6 = 1 and i % 100 = 7 then close * 1001e-3 else close end as close from walk w join num on num.ticker = w.ticker where d >= date '1996-01-01' and i % 37 <> 0)""",
    "mani": """mani as (
  select ticker, b, case b % 9 when 0 then null when 1 then 'no_data' when 2 then 'no_data' when 3 then 'failed' else 'ok' end as status,
    case when b % 9 in (0, 1, 2, 3) then null when b % 9 = 4 then last_d when b % 9 = 5 then date '1998-03-02' else date '1998-09-07' end as last_date,
    case when b % 9 = 2 then date '1998-10-26' when b % 9 = 1 then date '1998-09-01' end as attempt, case when b % 9 = 6 then date '1997-10-01' else date '1998-08-03' end as full_at,
    case when b % 9 = 5 then date '1998-10-20' end as empty_at, b = 25 as forced from num)""",
    "acts": """acts as (
  select q.ticker, q.d, 'dividend' as kind, case when b = 25 and q.first_one = 1 then q.close * 4e-1 else q.close * 1e-2 end as value from (
    select w.ticker, w.d, w.close, b, row_number() over (partition by w.ticker, date_trunc('quarter', w.d) order by w.d) as k, row_number() over (partition by w.ticker order by w.d) as first_one from walk w join num on num.ticker = w.ticker where b % 2 = 1) q where k = 1
  union all select ticker, date '1996-06-03', 'split', 2e0 from num where b % 7 = 0
  union all select ticker, date '1998-06-01', 'split', 3e0 from num where b % 7 = 0)""",
}
NEEDS = {"num": ["walk"], "vendor": ["walk", "num"], "clean": ["vendor"], "restated": ["walk", "num"], "mani": ["num"], "acts": ["walk", "num"],
         "hourly": [], "splits": ["bar"], "divs": ["walk"], "member": ["px"], "growth": ["walk", "divs"]}

SELECTS: dict[str, tuple[list[str], str]] = {
    "keep_last": (["hourly"], "select ticker, h, event_id, round(value, 6) as value from hourly where k = 1"),
    "sanitize_report": (["vendor"], """select ticker, cast(sum(case when k > 1 then 1 else 0 end) as bigint) as duplicate_dates, cast(sum(case when k = 1 and (close is null or close <= 0) then 1 else 0 end) as bigint) as bad_close,
  cast(sum(case when k = 1 and close > 0 and volume < 0 then 1 else 0 end) as bigint) as negative_volume, cast(sum(case when k = 1 and close > 0 and (low is null or high is null) then 1 else 0 end) as bigint) as partial_bars,
  cast(sum(case when k = 1 and close > 0 then 1 else 0 end) as bigint) as kept from (select *, row_number() over (partition by ticker, d order by arrival desc) as k from vendor) q group by ticker"""),
    "issues": (["vendor"], """select code, severity, count(*) as n, min(d) as first_date, max(d) as last_date, count(distinct ticker) as tickers from (
  select ticker, d, case when k > 1 then 'duplicate_dates' when close is null or close <= 0 then 'bad_close' when volume < 0 then 'negative_volume' when low is null or high is null then 'partial_bars' end as code,
    case when k > 1 or volume < 0 then 'info' when close is null or close <= 0 then 'error' else 'warning' end as severity from (select *, row_number() over (partition by ticker, d order by arrival desc) as k from vendor) q) z where code is not null group by code, severity"""),
    "sanitized": (["clean"], "select ticker, d, round(close, 6) as close, volume, round(low, 6) as low, round(high, 6) as high from clean"),
    "clean_ticker": (["num"], """select ticker, raw, case when lower(t) in ('', 'nan', 'none', 'n/a', '-', '—') then null else replace(upper(t), '.', '-') end as clean from (
  select ticker, raw, trim(split_part(raw, '[', 1)) as t from (select ticker, case b % 5 when 0 then ' brk.b[1] ' when 1 then 'N/A' when 2 then concat('tk', cast(b as varchar(3)), '[note 2]') when 3 then '—' else concat(' x.', cast(b as varchar(3))) end as raw from num) q) z"""),
    "dollar_volume": (["bar"], "select ticker, d, round(close * volume, 7) as dollars from bar"),
    "eligibility": (["spine", "walk", "acts", "num", "member"], """select ticker, case when n = 0 then 'empty' when gone then 'identity' when cover < 95e-2 then 'coverage' when zero_share > 5e-2 then 'zero volume' when not coalesce(dollars >= 1e4, false) then 'dollar volume' when coalesce(top_yield, 0e0) > 25e-2 then 'dividend yield' when sector = 'Unknown' then 'sector' else 'eligible' end as reason from (
  select p.ticker, count(p.close) as n, max(case when m.e <= date '1996-12-30' then 1 else 0 end) = 1 as gone, avg(case when p.close is null then 0e0 else 1e0 end) as cover, avg(case when p.close is null then null when w.volume < 10 then 1e0 else 0e0 end) as zero_share, PCTL(w.close * w.volume, 0.5) as dollars, max(y.yield) as top_yield,
    max(case when n.b % 11 = 3 then 'Unknown' else 'known' end) as sector from spine p join num n on n.ticker = p.ticker join member m on m.ticker = p.ticker left join walk w on w.ticker = p.ticker and w.d = p.d
  left join (select a.ticker, a.d, a.value / w.close as yield from acts a join walk w on w.ticker = a.ticker and w.d = a.d where a.kind = 'dividend') y on y.ticker = p.ticker and y.d = p.d where p.d <= date '1996-12-30' group by p.ticker) q"""),
    "phase_of": (["cal"], "select d, case when d < date '1996-01-01' then 'research' when d < date '1998-01-01' then 'validation' else 'holdout' end as phase from cal"),
    "stale_runs": (["walk"], """select ticker, max(n) as longest, cast(sum(case when n >= 5 then n else 0 end) as bigint) as stale from (select ticker, v, g, count(*) as n from (
  select ticker, v, row_number() over (partition by ticker order by i) - row_number() over (partition by ticker, v order by i) as g from (
    select ticker, i, case when i % 60 < 8 then max(case when i % 60 = 0 then round(close, 6) end) over (partition by ticker, cast(floor(i / 6e1) as int)) else round(close, 6) end as v from walk) h where v is not null) a group by ticker, v, g) c group by ticker"""),
    "split_rebase": (["bar", "splits"], """select b.ticker, b.d, round(b.close / coalesce(s.f, 1e0), 6) as close, round(b.volume * coalesce(s.f, 1e0), 4) as volume from bar b left join splits s on s.ticker = b.ticker and s.ex > b.d"""),
    "total_return": (["growth"], "select ticker, d, round(g, 8) as growth, round(close * g / last_value(g) over (partition by ticker order by d rows between unbounded preceding and unbounded following), 6) as tr_close from growth"),
    "ex_dividends": (["divs"], "select ticker, d, round(v, 6) as v from divs"),
    "large_dividends": (["acts", "walk"], """select ticker, d, round(value / prev, 6) as yield from (select w.ticker, w.d, a.value, lag(w.close, 1, w.close) over (partition by w.ticker order by w.d) as prev from walk w left join acts a on a.ticker = w.ticker and a.d = w.d and a.kind = 'dividend') q where value > 25e-2 * prev"""),
    "splits_of": (["acts"], "select ticker, d, value from acts where kind = 'split'"),
    "dividends_of": (["acts"], "select ticker, d, round(value, 6) as value from acts where kind = 'dividend'"),
    "as_traded_close": (["acts", "walk"], """select w.ticker, w.d, round(w.close * exp(sum(ln(coalesce(s.value, 1e0)))), 5) as close from walk w left join acts s on s.ticker = w.ticker and s.kind = 'split' and s.d > w.d group by w.ticker, w.d, w.close"""),
    "future_split_factor": (["acts", "num"], """select n.ticker, a.as_of, round(exp(coalesce(sum(ln(s.value)), 0e0)), 6) as factor from num n cross join (select date '1996-01-01' as as_of union all select date '1996-06-03' union all select date '1997-01-06' union all select date '1998-12-07') a
  left join acts s on s.ticker = n.ticker and s.kind = 'split' and s.d > a.as_of group by n.ticker, a.as_of"""),
    "forward_dividends": (["acts", "walk"], """select ticker, d, round(sum(value), 7) as dividends from (select w.ticker, w.d, a.value from (select ticker, d, lag(d) over (partition by ticker order by d) as prev from walk) w join (
  select ticker, d + 2 as ex, value from acts where kind = 'dividend') a on a.ticker = w.ticker and a.ex <= w.d and (w.prev is null or a.ex > w.prev)) q group by ticker, d"""),
    "members_on": (["member"], "select distinct ticker from member where (s is null or s <= date '1996-03-01') and (e is null or date '1996-03-01' < e)"),
    "ever_members": (["member"], "select distinct ticker from member where (s is null or s <= date '1996-06-01') and (e is null or e > date '1994-01-01')"),
    "naive_overlap": (["member", "cal"], """select c.d, round(avg(case when m.e is null then 1e0 else 0e0 end), 6) as share from cal c join member m on (m.s is null or m.s <= c.d) and (m.e is null or c.d < m.e) group by c.d"""),
    "identity_check": (["member", "spine"], """select p.ticker, count(*) as expected, count(p.close) as observed, round(count(p.close) / (count(*) * 1e0), 6) as share from spine p join member m on m.ticker = p.ticker and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e) group by p.ticker"""),
    "restatements": (["walk", "restated"], """select s.ticker, count(*) as overlap, cast(sum(case when abs(r.close / s.close - 1) > 1e-4 then 1 else 0 end) as bigint) as differing, round(max(abs(r.close / s.close - 1)), 8) as max_rel_diff,
  case when sum(case when abs(r.close / s.close - 1) > 1e-4 then 1 else 0 end) > 0 then 'full' else 'incremental' end as escalation from walk s join restated r on r.ticker = s.ticker and r.d = s.d group by s.ticker"""),
    "compare_sources": (["walk", "restated"], "select s.ticker, count(*) as overlap, round(avg(case when abs(r.close / s.close - 1) > 5e-3 then 1e0 else 0e0 end), 6) as share_differing, round(max(abs(r.close / s.close - 1)), 8) as max_rel_diff from walk s join restated r on r.ticker = s.ticker and r.d = s.d group by s.ticker"),
    "merge_new_wins": (["walk", "restated"], """select ticker, d, round(close, 6) as close from (select ticker, d, close, row_number() over (partition by ticker, d order by source desc) as k from (
  select ticker, d, close, 0 as source from walk union all select ticker, d, close, 1 from restated) u) q where k = 1"""),
    "common_dates": (["walk", "restated"], "select ticker, count(*) as n from (select ticker, d from walk intersect select ticker, d from restated) q group by ticker"),
    "lost_dates": (["walk", "restated"], "select ticker, d from walk where d >= date '1996-01-01' except select ticker, d from restated"),
    "vendor_adjustment": (["acts", "walk"], """select ticker, count(*) as n, round(max(abs(vendor / own - 1)), 9) as max_rel_diff from (
  select w.ticker, w.close / exp(sum(ln(coalesce(s.value, 1e0)))) as own, w.close / max(case when w.d < date '1996-06-03' and n.b % 7 = 0 then 6e0 when w.d < date '1998-06-01' and n.b % 7 = 0 then 3e0 else 1e0 end) as vendor
  from walk w join num n on n.ticker = w.ticker left join acts s on s.ticker = w.ticker and s.kind = 'split' and s.d > w.d group by w.ticker, w.d, w.close) q group by ticker"""),
    "split_residuals": (["acts", "walk"], """select ticker, d, row_no, round(ratio, 6) as ratio, abs(ln(ratio * value)) < abs(ln(ratio)) as unadjusted from (
  select w.ticker, w.d, cast(w.i as int) as row_no, s.value, w.close / lag(w.close) over (partition by w.ticker order by w.d) as ratio from walk w left join acts s on s.ticker = w.ticker and s.d = w.d and s.kind = 'split') q where value is not null and ratio is not null"""),
    "naive_dates": (["hourly"], "select ticker, cast(h as date) as d, count(*) as n from hourly where k = 1 group by 1, 2"),
    "sessions": (["cal"], "select d, row_number() over (order by d) as seq, lead(d) over (order by d) as next_session from cal"),
    "is_session": (["cal", "acts"], "select distinct a.d, c.d is not null as session from acts a left join cal c on c.d = a.d"),
    "last_complete_session": (["cal"], "select max(d) as session from cal where d + 5 <= date '1998-10-26'"),
    "sample_dates": (["cal"], "select distinct d from (select min(d) as d from cal group by year(d) union all select max(d) from cal where d < date '1998-01-01') q where d < date '1998-01-01'"),
    "off_calendar": (["acts", "cal"], "select a.ticker, a.d from acts a where not exists (select 1 from cal c where c.d = a.d)"),
    "members_mask": (["member", "walk", "spine"], """select p.ticker, p.d, case when bad.ticker is null and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e) then 1 else 0 end as member from spine p join member m on m.ticker = p.ticker left join (
  select p.ticker from spine p join member m on m.ticker = p.ticker and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e) group by p.ticker having count(p.close) < 98e-2 * count(*)) bad on bad.ticker = p.ticker"""),
    "identity_verdict": (["member", "spine", "walk"], """select ticker, expected, observed, round(observed / (expected * 1e0), 6) as obs_share, round(volume_share, 6) as volume_share, case when observed = 0 then 'no_prices' when observed < 5e-1 * expected then 'symbol_reuse' when observed < 98e-2 * expected then 'partial' else 'verified' end as verdict from (
  select p.ticker, count(*) as expected, count(p.close) as observed, coalesce(avg(case when p.close is null then null when w.volume > 0 then 1e0 else 0e0 end), 0e0) as volume_share from spine p join member m on m.ticker = p.ticker and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e)
  left join walk w on w.ticker = p.ticker and w.d = p.d group by p.ticker) q"""),
    "size_check": (["member", "cal"], "select d, members, expected, abs(members - expected) > 2 as off from (select c.d, count(distinct m.ticker) as members, 19 as expected from cal c join member m on (m.s is null or m.s <= c.d) and (m.e is null or c.d < m.e) group by c.d) q"),
    "log_density": (["member"], "select yr, count(*) as changes from (select year(s) as yr from member where s is not null union all select year(e) from member where e is not null) q group by yr"),
    "price_coverage": (["member", "spine"], "select year(p.d) as yr, count(distinct p.ticker) as members, count(distinct case when p.close is not null then p.ticker end) as priced, round(avg(case when p.close is null then 0e0 else 1e0 end), 6) as coverage from spine p join member m on m.ticker = p.ticker and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e) group by 1"),
    "survivorship_report": (["member", "spine"], """select yr, members, survivors, round(survivors / (members * 1e0), 6) as survivor_share, round(coverage, 6) as coverage from (select year(p.d) as yr, count(distinct p.ticker) as members, count(distinct case when m.e is null then p.ticker end) as survivors, avg(case when p.close is null then 0e0 else 1e0 end) as coverage
  from spine p join member m on m.ticker = p.ticker and (m.s is null or m.s <= p.d) and (m.e is null or p.d < m.e) group by 1) q"""),
    "manifest": (["bar"], "select ticker, count(*) as n, min(d) as first_d, max(d) as last_d from bar group by ticker"),
    "refresh_plan": (["mani"], """select ticker, case when plan like 'skip%' then 'skip' when plan like 'full%' then 'full' else 'incremental' end as mode, plan as reason from (
  select ticker, case when forced then 'full: forced' when status is null then 'full: new ticker' when status = 'no_data' and attempt is not null and attempt > date '1998-11-02' - 30 then 'skip: no data, retried recently' when status = 'no_data' then 'full: retry after no data'
    when last_date is null then 'full: previous attempt failed' when full_at is null or full_at <= date '1998-11-02' - 365 then 'full: periodic' when last_date >= date '1998-10-26' then 'skip: up to date'
    when empty_at is not null and last_date < date '1998-10-26' - 10 and empty_at > date '1998-11-02' - 30 then 'skip: ended, probed recently' else 'incremental: new sessions' end as plan from mani) q"""),
    "refresh_counts": (["mani"], "select coalesce(status, 'new') as status, count(*) as n from mani group by 1"),
    "empty_probe": (["mani"], "select ticker, case when last_date < date '1998-10-26' - 10 then date '1998-11-02' end as last_empty_at from mani where last_date is not null"),
    "manifest_lookup": (["mani"], "select ticker, status, last_date, full_at from mani where ticker = 'Brand#13'"),
    "group_pairs": (["walk"], "select g, cast(n * (n - 1) / 2 as bigint) as pairs from (select (cast(substr(ticker, 7, 2) as int) - 1) % 5 as g, count(distinct ticker) as n from walk group by 1) q"),
}
