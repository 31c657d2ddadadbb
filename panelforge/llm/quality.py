"""Quality rules whose thresholds are certified on labelled documents by exact binomial bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import materialize

SPACES = "[\\x20\\x09-\\x0D]+"
#: The rules that get thresholds: name, and a ratio in thousandths as (numerator, denominator) columns. A document fails a rule if its ratio is above the threshold.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Thresholds tried, the most lenient first, in thousandths of the ratio.
GRID = {
    "symbols": [900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20],
    "dup_lines": [900, 800, 700, 600, 500, 400, 350, 300, 250, 200, 150, 100],
    "repeats": [480, 460, 440, 420, 400, 380, 360, 340, 320, 300, 280, 260, 240, 220, 200],
    "word_length": [60000, 40000, 30000, 25000, 20000, 18000, 16000, 14000, 12000, 11000, 10000],
}
#: Share of good documents that all rules of a stratum together may reject, and the chance that any stratum breaks that.
RISK, DELTA = 0.02, 0.05


def signals(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts that the rules look at, of whole texts; a null text has no words.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word),
    n_dup_lines (equal to an earlier one), n_repeat_words (words in windows of
    three that occur twice or more, the first included): all long.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(*keep, text.alias("_t"), words.alias("_w"), lines.alias("_l"))
    n = F.size("_w")

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))

    inner = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.transform(inner, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    # only a text with equal hashes can have equal windows; those are then compared as texts
    pairs = F.array_sort(F.transform(inner, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))

    def same(j: Column) -> Column:
        g = F.get("_s", j)["g"]
        return F.coalesce(g == F.get("_s", j - 1)["g"], F.lit(False)) | F.coalesce(g == F.get("_s", j + 1)["g"], F.lit(False))

    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), same)
    at = F.transform(twice, lambda j: F.get("_s", j)["i"])
    covered = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))
    repeat = F.when(F.col("_s").isNull(), 0).otherwise(F.size(covered))
    return df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
    )


def _binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, summed exactly from log terms."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.lit(0.0).alias("s"))
    end = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k), start,
        lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1) * odds)).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
    )
    return F.when(k >= n, 1.0).otherwise(end["s"])


def certified_thresholds(labelled: DataFrame, strata: int, stratum: str = "stratum", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, threshold): the strictest thresholds that are certified.

    labelled: a row for each good document, with the stratum and the columns of
    signals(). For each stratum and rule the thresholds are tested in turn, the
    most lenient first, until one can't be certified (a fixed sequence, so trying
    many costs nothing); the hypothesis that a threshold rejects more than
    risk / rules of the good documents is rejected if the exact binomial chance of
    so few rejections is at most delta / (rules * strata) (Bonferroni). With
    confidence 1 - delta, no stratum loses over `risk` of its good documents.
    A stratum with too few good documents gets no thresholds.
    """
    each, level = risk / len(RULES), delta / (len(RULES) * max(1, strata))
    tried = [(r, i, t) for r, ts in GRID.items() for i, t in enumerate(ts)]
    sums = [F.sum((1000 * F.col(RULES[r][0]) > t * F.col(RULES[r][1])).cast("long")).alias(f"c{j}") for j, (r, i, t) in enumerate(tried)]
    counts = labelled.groupBy(stratum).agg(F.count("*").alias("n"), *sums)
    long = counts.select(
        stratum, "n",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(t).alias("threshold"), F.col(f"c{j}").alias("k")) for j, (r, i, t) in enumerate(tried)])).alias("x"),
    ).select(stratum, "n", "x.*")
    tested = long.withColumn("bad", _binomial_at_most(F.col("k"), F.col("n"), each) > level)
    return (
        tested.groupBy(stratum, "rule")
        .agg(F.array_sort(F.collect_list(F.struct("step", "threshold", "bad"))).alias("s"))
        .select(stratum, "rule", "s", F.when(F.exists("s", lambda x: x["bad"]), F.filter("s", lambda x: x["bad"])[0]["step"]).otherwise(F.size("s")).alias("ok"))
        .where("ok > 0")
        .select(stratum, "rule", F.get("s", F.col("ok") - 1)["threshold"].alias("threshold"))
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", version: bool = False) -> DataFrame:
    """Per document: doc_id, the counts of signals(), base_failed, stratum, failed_rules, kept.

    docs: doc_id, text and the stratum column; labels: doc_id, quality (1: good).
    base_failed: under 50 words, or over half of them in repeated windows. The
    rules of certified_thresholds() then decide, by stratum (null: 'none').
    Of several labels of a document the best counts, and those without quality
    count for nothing; labelled documents that fail the base rules teach nothing,
    and copies of one text in a stratum teach as one.
    Every row of docs gives one row, repeated ones too. With `version` each has a
    hash of its text, which tells texts of one doc_id apart. Other columns of docs
    are not read.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("none")).alias("stratum"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    more = ["version"] if version else []
    rows = materialize(signals(docs, "doc_id", "stratum", "version"), "signals")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    strata = rows.select("stratum").distinct().count()
    # copies of a text are one draw, as the bound is for independent ones
    limits = certified_thresholds(rows.where("not base_failed").join(good, "doc_id").dropDuplicates(["stratum", "version"]), strata)
    limits = materialize(limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "threshold"))).alias("limits")), "limits")
    failed = [F.when(1000 * F.col(a) > F.try_element_at("limits", F.lit(r)) * F.col(b), F.lit(r)) for r, (a, b) in RULES.items()]
    rules = F.array_compact(F.array(*failed))
    return (
        rows.join(F.broadcast(limits), "stratum", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum", rules.alias("rules"), *more)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum",
            F.array_join("rules", ",").alias("failed_rules"),
            (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), *more,
        )
    )


def _sql() -> str:
    grid = ", ".join(f"('{r}', {i}, {t})" for r, ts in GRID.items() for i, t in enumerate(ts))
    ratio = " ".join(f"when '{r}' then 1000 * {a} > t * {b}" for r, (a, b) in RULES.items())
    return rf"""
with w as (
  select doc_id, coalesce(lang, 'none') as stratum, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g), (values (0), (1), (2)) as o(k)
  where n > 1 group by doc_id),
s as (
  select doc_id, stratum, t, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
good as (select doc_id from labels where quality is not null group by doc_id having max(quality) = 1),
c as (
  select stratum, rule, step, t, count(*) as n, count(*) filter (case rule {ratio} end) as k
  from (select distinct on (stratum, t) * exclude (t) from b join good using (doc_id) where not base_failed) u, (values {grid}) as v(rule, step, t) group by all),
p as (
  select *, case when k >= n then 1 else (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)})))
    from range(0, k + 1) as q(i)) end > {DELTA / len(RULES)} / (select count(distinct stratum) from b) as bad
  from c),
ok as (select stratum, rule, step, t from (select *, bool_or(bad) over (partition by stratum, rule order by step) as any_bad from p) where not any_bad),
lim as (select stratum, rule, arg_max(t, step) as t from ok group by all),
f as (
  select doc_id, string_agg(rule, ',' order by array_position({list(RULES)}, rule)) as failed_rules
  from (select * exclude (t) from b) b join lim using (stratum) where case rule {ratio} end group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum,
  coalesce(failed_rules, '') as failed_rules, not base_failed and failed_rules is null as kept
from b left join f using (doc_id)"""


QUALITY_SQL = _sql().replace("\\\\", "\\")
