"""Cleaning with issues, the refresh of a store, and audits, each as one plan over all tickers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.config import Refresh
from panelforge.sources import store
from panelforge.sources.vendors import DataSource

# What a cleaning step reports, and how grave it is.
SEVERITY = {"duplicate_dates": "info", "bad_close": "error", "negative_volume": "info", "partial_bars": "warning"}
MANIFEST = "ticker string, status string, first_date date, last_date date, n_rows long, last_attempt_at timestamp, last_full_at timestamp, last_empty_at timestamp, message string, written timestamp"


def naive_dates(column: str):
    """The calendar date of a time stamp as text, whatever zone it names: the zone is dropped, nothing is converted."""
    return F.to_date(F.substring(F.col(column).cast("string"), 1, 10))


def sanitize(prices: DataFrame, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """(clean rows, issues by ticker and code): the last row of a date stays, closes of 0 or less go, volumes below 0 become null."""
    last = F.row_number().over(W.partitionBy("ticker", "date").orderBy(F.desc(arrival)))
    partial = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull()
    bad = F.col("close").isNull() | F.isnan("close") | (F.col("close") <= 0)
    code = F.when(F.col("_k") > 1, "duplicate_dates").when(bad, "bad_close").when(F.col("volume") < 0, "negative_volume").when(partial, "partial_bars")
    marked = prices.withColumn("_k", last).withColumn("code", code)
    grave = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    issues = marked.where("code is not null").groupBy("ticker", "code").agg(F.count("*").alias("count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    clean = marked.where((F.col("_k") == 1) & ~bad).withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))
    return clean.drop("_k", "code", arrival), issues.withColumn("severity", grave[F.col("code")])


def sanitize_actions(actions: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Dividends and splits with a value above 0; the last of a ticker, date and kind."""
    last = F.row_number().over(W.partitionBy("ticker", "date", "kind").orderBy(F.desc(arrival)))
    return actions.where(F.col("kind").isin("dividend", "split") & (F.col("value") > 0)).withColumn("_k", last).where("_k = 1").drop("_k", arrival)


def summarize_issues(issues: DataFrame) -> DataFrame:
    """(code, severity, tickers, count), the gravest first."""
    out = issues.groupBy("code", "severity").agg(F.count_distinct("ticker").alias("tickers"), F.sum("count").alias("count"))
    return out.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), "code")


def plan_refresh(manifest: DataFrame, tickers: DataFrame, end: date, now: datetime, cfg: Refresh = Refresh(), force: bool = False) -> DataFrame:
    """(ticker, mode, reason) of every ticker: forced, new, backed off, failed, periodic, up to date, ended or incremental, in this order."""
    back_off = F.lit(now - timedelta(days=cfg.retry_no_data_days)).cast("timestamp")
    rules = [
        (F.lit(force), "full", "forced"),
        (F.col("status").isNull(), "full", "new ticker"),
        ((F.col("status") == "no_data") & (F.col("last_attempt_at") > back_off), "skip", "no data, retried recently"),
        (F.col("status") == "no_data", "full", "retry after no data"),
        (F.col("last_date").isNull(), "full", "previous attempt failed"),
        (F.col("last_full_at").isNull() | (F.col("last_full_at") <= F.lit(now - timedelta(days=cfg.full_refresh_after_days)).cast("timestamp")), "full", "periodic"),
        (F.col("last_date") >= F.lit(end), "skip", "up to date"),
        ((F.col("last_date") < F.lit(end - timedelta(days=cfg.overlap_days))) & (F.col("last_empty_at") > back_off), "skip", "ended, probed recently"),
    ]
    mode = reason = F
    for test, m, r in rules:
        mode, reason = mode.when(test, m), reason.when(test, r)
    return tickers.join(manifest, "ticker", "left").select("ticker", mode.otherwise("incremental").alias("mode"), reason.otherwise("new sessions").alias("reason"), "last_date")


def restated(stored: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """(ticker, overlap, differing) over dates that both have."""
    both = stored.select("ticker", "date", F.col("close").alias("old")).join(new.select("ticker", "date", "close"), ["ticker", "date"])
    return both.groupBy("ticker").agg(F.count("*").alias("overlap"), F.count_if(F.abs(F.col("close") / F.col("old") - 1) > tolerance).alias("differing"))


def merge(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """All rows of both; of one key that of `new`."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))).where("_k = 1").drop("_k", "_new")


@dataclass(frozen=True)
class Store:
    """Tables of one folder: prices, actions, manifest, fetch log and issues."""

    spark: SparkSession
    path: str

    def table(self, name: str, schema: str) -> DataFrame:
        """A table, empty if nothing was written."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def prices(self) -> DataFrame:
        return self.table("prices", "date date, open double, high double, low double, close double, volume double, ticker string")

    def actions(self) -> DataFrame:
        return self.table("actions", "date date, kind string, value double, ticker string")

    def manifest(self) -> DataFrame:
        rows = self.table("manifest", MANIFEST)
        return rows.withColumn("_k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("written")))).where("_k = 1").drop("_k", "written")

    def lookup(self, ticker: str) -> dict | None:
        """The manifest row of a ticker."""
        row = self.manifest().where(F.col("ticker") == ticker).first()
        return row.asDict() if row else None

    def log(self) -> DataFrame:
        return self.table("log", "ts timestamp, ticker string, mode string, status string, rows long, message string").orderBy("ts", "ticker")

    def issues(self) -> DataFrame:
        return self.table("issues", "ts timestamp, ticker string, code string, severity string, count long, first_date date, last_date date").orderBy("ts", "ticker", "code")


def refresh(where: Store, source: DataSource, tickers: list[str], start: str, end: str, now: datetime, cfg: Refresh = Refresh(), force: bool = False) -> DataFrame:
    """Bring a store up to date; (ticker, mode, reason, status, rows) of every ticker, which is also the fetch log.

    Incremental tickers are read from some days before their last date; one whose
    overlap was restated is read anew in full. An empty answer deletes nothing.
    The plan and the restated tickers, one row each, are read by the driver.
    """
    spark = where.spark
    plan = plan_refresh(where.manifest(), spark.createDataFrame([(t,) for t in tickers], "ticker string"), date.fromisoformat(end), now, cfg, force).collect()
    modes = {r["ticker"]: (r["mode"], r["reason"]) for r in plan}
    more = [r for r in plan if r["mode"] == "incremental"]
    stored = where.prices()
    if more:
        since = min(r["last_date"] for r in more) - timedelta(days=cfg.overlap_days)
        overlap = source.fetch(spark, [r["ticker"] for r in more], str(since), end).prices
        for r in restated(stored, overlap, cfg.restatement_tolerance).where("differing > 0").collect():
            modes[r["ticker"]] = ("full", "restated")
    new = []
    for mode, first in (("full", start), ("incremental", str(since) if more else start)):
        own = [t for t, (m, _) in modes.items() if m == mode]
        if own:
            new.append((own, source.fetch(spark, own, first, end)))
    status = {t: ("skipped", 0) for t in modes}
    ts = F.lit(now).cast("timestamp")
    for own, history in new:
        clean, issues = sanitize(history.prices.withColumn("arrival", F.monotonically_increasing_id()))
        full = modes[own[0]][0] == "full"
        kept = clean if full else merge(stored.where(F.col("ticker").isin(own)).select(*clean.columns), clean)
        counts = {r["ticker"]: r for r in kept.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).collect()}
        found = [t for t in own if t in counts]
        if found:
            scratch = f"{where.path}/_new"
            kept.write.mode("overwrite").parquet(scratch)  # the merge reads the partitions that it replaces
            store.write_prices(spark.read.parquet(scratch), f"{where.path}/prices")
            actions = sanitize_actions(history.actions.withColumn("arrival", F.monotonically_increasing_id()))
            acts = actions if full else merge(where.actions().where(F.col("ticker").isin(found)).select(*actions.columns), actions, ("ticker", "date", "kind"))
            acts.write.mode("overwrite").parquet(scratch)
            store.write_prices(spark.read.parquet(scratch), f"{where.path}/actions")
            store.append(issues.select(ts.alias("ts"), "ticker", "code", "severity", "count", "first_date", "last_date"), f"{where.path}/issues")
        for t in own:
            status[t] = ("ok", counts[t]["n"]) if t in counts else ("no_data", 0)
        old = {r["ticker"]: r for r in where.manifest().where(F.col("ticker").isin(own)).collect()}
        rows = []
        for t in own:
            c, o = counts.get(t), old.get(t)
            last = c["b"] if c else o and o["last_date"]
            stale = last is not None and last < date.fromisoformat(end) - timedelta(days=cfg.overlap_days)
            rows.append((t, status[t][0] if c or not o or o["status"] != "ok" else "ok", c["a"] if c else o and o["first_date"], last, c["n"] if c else o and o["n_rows"], now, now if full and c else o and o["last_full_at"], now if stale else None, modes[t][1], now))
        store.append(spark.createDataFrame(rows, MANIFEST), f"{where.path}/manifest")
    out = spark.createDataFrame([(t, *modes[t], *status[t]) for t in modes], "ticker string, mode string, reason string, status string, rows long")
    store.append(out.select(ts.alias("ts"), "ticker", "mode", "status", "rows", F.col("reason").alias("message")), f"{where.path}/log")
    return out


def fingerprint(prices: DataFrame) -> str:
    """16 hex digits of all rows, whatever their order."""
    row = store.content_hash(prices.withColumn("_all", F.lit("x")), "_all").first()
    return row["hash"][:16] if row else "0" * 16
