"""Resampling and multiple testing as SQL, with random numbers that any engine computes alike."""

from __future__ import annotations

PRIME = 2147483647
#: Bootstrap draws, and blocks of the cross-validation by combinations.
DRAWS, SLICES = 5000, 16


def mix(seed: str) -> str:
    """A bigint in [0, PRIME) of a non-negative one under 2^31, by quadratic rounds that stay within 63 bits."""
    for k in (12345, 54321):
        seed = f"((({seed}) * ({seed}) + {k} * ({seed}) + 7) % {PRIME})"
    return seed


PANELS = {
    "dates": "dates as (select d, row_number() over (order by d) as i, count(*) over () as n from (select distinct d from mon) x)",
    "seeds": f"seeds as (select s.k as b, i, n, cast((s.k * 1000003 + i * 7919 + 17) % {PRIME} as bigint) as h from dates cross join SERIES({DRAWS}) s)",
    "u": f"u as (select b, i, n, h1, {mix('h1')} as h2 from (select b, i, n, {mix('h')} as h1 from seeds) q)",
    # the last restart before a row, with its drawn start, in one number
    "pick": f"""pick as (
  select b, cast((m % 100000 + i - floor(m / 100000)) % n as bigint) + 1 as pos from (
    select b, i, n, max(case when i = 1 or h1 < {PRIME // 10} then i * 100000 + h2 % n end) over (partition by b order by i rows between unbounded preceding and current row) as m from u) q)""",
    "ser": "ser as (select m.strategy, dates.i, m.r from mon m join dates on dates.d = m.d)",
    "obs": "obs as (select strategy, count(*) as n, avg(r) as m, stddev_samp(r) as s from ser group by strategy)",
    "boot": "boot as (select strategy, b, avg(r) as mb from pick join ser on ser.i = pick.pos group by strategy, b)",
    "pv": "pv as (select o.strategy, sqrt(o.n * 1e0) * o.m / max(w.om) as t, (1e0 + sum(case when mb - o.m >= o.m then 1 else 0 end)) / (1e0 + count(*)) as p from obs o join boot on boot.strategy = o.strategy join om w on w.strategy = o.strategy group by o.strategy, o.n, o.m)",
    "om": "om as (select boot.strategy, sqrt(max(o.n) * 1e0) * stddev_samp(mb) as om from boot join obs o on o.strategy = boot.strategy group by boot.strategy)",
    "blk": f"blk as (select strategy, cast(floor((i - 1) * {SLICES} / (n * 1e0)) as int) as k, count(*) as c, sum(r) as s1, sum(r * r) as s2 from (select ser.strategy, ser.i, ser.r, x.n from ser cross join (select max(i) as n from ser) x) q group by 1, 2)",
    "cut": f"cut as (select k as mask from SERIES({2**SLICES - 2}) s where bit_count(k) = {SLICES // 2})",
    "perf": """perf as (
  select strategy, mask, inside, case when c > 2 and s2 / c - s1 / c * s1 / c > 1e-12 then round(s1 / c / sqrt(s2 / c - s1 / c * s1 / c), 9) else 0e0 end as sr from (
    select strategy, mask, case when floor(mask / power(2e0, k)) % 2 = 1 then 1 else 0 end as inside, sum(c) as c, sum(s1) as s1, sum(s2) as s2 from blk cross join cut group by 1, 2, 3) q)""",
}
NEEDS = {
    "dates": ["mon"], "seeds": ["dates"], "u": ["seeds"], "pick": ["u"], "ser": ["mon", "dates"], "obs": ["ser"], "boot": ["pick", "ser"],
    "om": ["boot", "obs"], "pv": ["obs", "boot", "om"], "blk": ["ser"], "cut": [], "perf": ["blk", "cut"],
}
RANKED = "(select strategy, p, row_number() over (order by p, strategy) as k, count(*) over () as m from pv)"
STEP_UP = "least(1e0, min(p * m / k * {0}) over (order by k rows between current row and unbounded following))"

SELECTS: dict[str, tuple[list[str], str]] = {
    "stationary_bootstrap": (["pick"], "select b, count(*) as n, count(distinct pos) as places, min(pos) as low, max(pos) as high from pick group by b"),
    "bootstrap_ci": (["boot"], "select strategy, round(PCTL(mb, 0.025), 8) as low, round(PCTL(mb, 0.975), 8) as high from boot group by strategy"),
    "reality_check": (["boot", "obs"], """select round(max(v), 6) as stat, round((1e0 + sum(case when vb >= v then 1 else 0 end)) / (1e0 + count(*)), 6) as p from (select max(sqrt(n * 1e0) * m) as v from obs) o cross join (
  select b, max(sqrt(n * 1e0) * (mb - m)) as vb from boot join obs on obs.strategy = boot.strategy group by b) z"""),
    "spa_test": (["boot", "obs", "om"], """select round(max(v), 4) as stat, round((1e0 + sum(case when l >= v then 1 else 0 end)) / (1e0 + count(*)), 6) as p_lower, round((1e0 + sum(case when c >= v then 1 else 0 end)) / (1e0 + count(*)), 6) as p_consistent, round((1e0 + sum(case when u >= v then 1 else 0 end)) / (1e0 + count(*)), 6) as p_upper from (
  select greatest(0e0, max(sqrt(n * 1e0) * m / om)) as v from obs join om on om.strategy = obs.strategy) o cross join (
  select b, greatest(0e0, max(q * (mb - greatest(m, 0e0)))) as l, greatest(0e0, max(q * (mb - case when q * m <= -sqrt(2 * ln(ln(n))) then 0e0 else m end))) as c, greatest(0e0, max(q * (mb - m))) as u from (
  select b, mb, m, n, sqrt(n * 1e0) / om as q from boot join obs on obs.strategy = boot.strategy join om on om.strategy = boot.strategy) a group by b) z"""),
    "romano_wolf": (["boot", "obs", "om", "pv"], """select strategy, round(max(p) over (order by k rows between unbounded preceding and current row), 6) as p from (select strategy, k, (1e0 + sum(case when mx >= t then 1 else 0 end)) / (1e0 + count(*)) as p from (
  select r.strategy, r.k, r.t, max(e.s) over (partition by e.b order by r.k rows between current row and unbounded following) as mx from (select strategy, t, row_number() over (order by t desc, strategy) as k from pv) r join (
  select boot.strategy, b, sqrt(n * 1e0) * (mb - m) / om as s from boot join obs on obs.strategy = boot.strategy join om on om.strategy = boot.strategy) e on e.strategy = r.strategy) a group by strategy, k) z"""),
    "benjamini_hochberg": (["pv"], f"select strategy, round(p, 6) as p, round({STEP_UP.format('1e0')}, 6) as adjusted from {RANKED} q"),
    "benjamini_yekutieli": (["pv"], f"select strategy, round({STEP_UP.format('h')}, 6) as adjusted from {RANKED} q cross join (select sum(1e0 / k) as h from (select row_number() over (order by strategy) as k from pv) s) z"),
    "storey_pi0": (["pv"], "select round(least(1e0, sum(case when p > 0.5 then 1 else 0 end) / (count(*) * 5e-1)), 6) as pi0, cast(sum(case when p <= 0.05 then 1 else 0 end) as bigint) as found, count(*) as m from pv"),
    "p_histogram": (["pv"], "select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n from pv group by 1"),
    "sharpe_moments": (["ser", "obs"], """select strategy, n, round(sr, 6) as sr, round(g, 5) as skew, round(k, 5) as kurt, round(sqrt((1 - g * sr + (k - 1) / 4 * sr * sr) / (n - 1)), 6) as se from (
  select o.strategy, o.n, o.m / o.s as sr, avg(power(r - o.m, 3)) / power(avg(power(r - o.m, 2)), 15e-1) as g, avg(power(r - o.m, 4)) / power(avg(power(r - o.m, 2)), 2) as k from ser join obs o on o.strategy = ser.strategy where o.s > 0 group by o.strategy, o.n, o.m, o.s) q"""),
    "effective_trials": (["ser"], """select count(distinct a) as n, round(count(distinct a) * count(distinct a) / sum(rho * rho), 4) as participation from (
  select a.strategy as a, b.strategy as b, corr(a.r, b.r) as rho from ser a join ser b on a.i = b.i group by a.strategy, b.strategy) q"""),
    "spearman": (["ser"], """select round(corr(ra, rb), 6) as rho from (select strategy, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2e0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2e0 as rb from (
  select strategy, round(avg(case when i <= 40 then r end), 9) as a, round(avg(case when i > 40 then r end), 9) as b from ser group by strategy) q) z"""),
    "cscv_pbo": (["perf"], """select count(*) as splits, round(avg(case when w <= 5e-1 then 1e0 else 0e0 end), 6) as pbo, round(avg(ln(w / (1 - w))), 5) as mean_logit from (select i.mask, (o.rk + 0e0) / (o.m + 1) as w from (
  select mask, strategy, row_number() over (partition by mask order by sr desc, strategy) as k from perf where inside = 1) i join (
  select mask, strategy, count(*) over (partition by mask) as m, rank() over (partition by mask order by sr) + (count(*) over (partition by mask, sr) - 1) / 2e0 as rk from perf where inside = 0) o
  on o.mask = i.mask and o.strategy = i.strategy where i.k = 1) z"""),
    "shift_test": (["ser"], """select o.strategy, round(ob, 6) as difference, round((1e0 + sum(case when abs(sh) >= abs(ob) then 1 else 0 end)) / (1e0 + count(*)), 6) as p, count(*) as shifts from (
  select strategy, round(sqrt(12e0) * (avg(case when hi = 1 then r end) / nullif(stddev_samp(case when hi = 1 then r end), 0) - avg(case when hi = 0 then r end) / nullif(stddev_samp(case when hi = 0 then r end), 0)), 9) as ob from (
    select b.strategy, b.r, case when a.r > 0 then 1 else 0 end as hi from ser a join ser b on b.i = a.i where a.strategy = 0) x group by strategy) o join (
  select strategy, k, round(sqrt(12e0) * (avg(case when hi = 1 then r end) / nullif(stddev_samp(case when hi = 1 then r end), 0) - avg(case when hi = 0 then r end) / nullif(stddev_samp(case when hi = 0 then r end), 0)), 9) as sh from (
    select b.strategy, s.k, b.r, a.hi from (select ser.i, dates.n, case when r > 0 then 1 else 0 end as hi from ser join dates on dates.i = ser.i where strategy = 0) a
    join (select i as k from dates) s on s.k < a.n join ser b on b.i = (a.i + s.k - 1) % a.n + 1) y group by strategy, k) z on z.strategy = o.strategy group by o.strategy, ob"""),
}
