"""Who was a member when: static lists, files, and an index walked back from its change log."""

from __future__ import annotations

from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.store import html_table

MEMBERS = "ticker string, start date, end date, sector string"


def clean_symbol(raw):
    """A column of symbols without footnotes, in upper case, with - for a dot; null for what stands for none."""
    c = F.trim(F.regexp_replace(raw, r"\[[^\]]*\]", ""))
    return F.when(~F.lower(c).isin("", "nan", "none", "n/a", "-", "—", "–"), F.replace(F.upper(c), F.lit("."), F.lit("-")))


@dataclass(frozen=True)
class Universe:
    """Intervals (ticker, start, end, sector), start included, end not, null for open; and what to know of them."""

    members: DataFrame
    caveat: str = ""

    def on(self, d: str) -> DataFrame:
        day = F.lit(d).cast("date")
        return self.members.where((F.col("start").isNull() | (F.col("start") <= day)) & (F.col("end").isNull() | (day < F.col("end")))).select("ticker").distinct()

    def ever(self, low: str, high: str) -> DataFrame:
        return self.members.where((F.col("start").isNull() | (F.col("start") <= F.lit(high).cast("date"))) & (F.col("end").isNull() | (F.col("end") > F.lit(low).cast("date")))).select("ticker").distinct()

    def sectors(self, tickers: DataFrame) -> DataFrame:
        """The first known sector of each ticker, else Unknown."""
        known = self.members.groupBy("ticker").agg(F.min("sector").alias("sector"))
        return tickers.join(known, "ticker", "left").select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


def static_universe(spark: SparkSession, tickers: list[str]) -> Universe:
    return Universe(spark.createDataFrame([(t.upper(), None, None, None) for t in tickers], MEMBERS), "a list of today: its past members are those that lasted")


def file_universe(spark: SparkSession, path: str) -> Universe:
    """CSV intervals: ticker, start, end and, if it is there, sector."""
    rows = spark.read.option("header", True).csv(path)
    sector = F.col("sector") if "sector" in rows.columns else F.lit(None).cast("string")
    return Universe(rows.select(clean_symbol(F.col("ticker")).alias("ticker"), F.to_date("start").alias("start"), F.to_date("end").alias("end"), sector.alias("sector")))


def reconstruct(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, anomalies) of current (ticker) and changes (date, added, removed), walked back from today ticker by ticker.

    A ticker added on a day was no member before; one removed was. Of one day the
    additions come first, as it is walked back. What does not fit is an anomaly and
    changes nothing. One group is the changes of one ticker.
    """
    events = changes.select("date", F.expr("stack(2, 'added', added, 'removed', removed) as (kind, ticker)")).where("ticker is not null")
    both = events.select("ticker", "date", "kind").union(current.select("ticker", F.lit(None).cast("date"), F.lit("now")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        member, end, rows = bool((pdf["kind"] == "now").any()), None, []
        log = pdf[pdf["kind"] != "now"].sort_values(["date", "kind"], ascending=[False, True])
        for d, kind in zip(log["date"], log["kind"]):
            if (kind == "added") != member:
                rows.append((d, None, "added_but_not_member_afterwards" if kind == "added" else "removed_but_member_afterwards"))
            elif member:
                rows.append((d, end, None))
                member = False
            else:
                member, end = True, d
        if member:
            rows.append((None, end, None))
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]] * len(rows), "start": [r[0] for r in rows], "end": [r[1] for r in rows], "anomaly": [r[2] for r in rows]})

    out = both.groupBy("ticker").applyInPandas(one, "ticker string, start date, end date, anomaly string")
    return out.where("anomaly is null").select("ticker", "start", "end"), out.where("anomaly is not null").select("ticker", F.col("start").alias("date"), "anomaly")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of a CSV of renamed tickers; lines with # are comments."""
    return spark.read.option("header", True).option("comment", "#").csv(path).select(F.upper(F.trim("old")).alias("old"), F.upper(F.trim("new")).alias("new"))


def rename(df: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """df with old tickers replaced by new ones in the columns; a handful of aliases."""
    for c in columns:
        df = df.join(F.broadcast(aliases.select(F.col("old").alias(c), F.col("new").alias("_new"))), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def index_universe(current: DataFrame, changes: DataFrame, aliases: DataFrame | None = None) -> tuple[Universe, DataFrame]:
    """An index from its constituents (ticker, sector) and change log; the anomalies too."""
    if aliases is not None:
        current, changes = rename(current, aliases, "ticker"), rename(changes, aliases, "added", "removed")
    intervals, anomalies = reconstruct(current.select("ticker"), changes)
    members = intervals.join(current.groupBy("ticker").agg(F.min("sector").alias("sector")), "ticker", "left").select("ticker", "start", "end", "sector")
    return Universe(members, "exact only if the change log is complete"), anomalies


def build_universe(kind: str, **parts):
    """static (spark, tickers), file (spark, path) or index (current, changes, aliases)."""
    return {"static": static_universe, "file": file_universe, "index": index_universe}[kind](**parts)


def constituents(spark: SparkSession, page: str) -> DataFrame:
    """(ticker, sector) of the table of a page that has the columns Symbol and GICS Sector."""
    rows = [(unescape(r["Symbol"]), r["GICS Sector"]) for r in html_table(page, ["Symbol", "GICS Sector"])]
    return spark.createDataFrame(rows, "symbol string, sector string").select(clean_symbol(F.col("symbol")).alias("ticker"), "sector").where("ticker is not null")


def change_log(spark: SparkSession, page: str) -> DataFrame:
    """(date, added, removed) of the table of a page whose header begins with Date, Added, Removed; rows without a date go, as do second header rows."""
    rows = [(r["Date"], r.get("Added"), r.get("Removed")) for r in html_table(page, ["Date", "Added", "Removed"])]
    df = spark.createDataFrame(rows, "day string, added string, removed string")
    day = F.coalesce(F.try_to_timestamp("day", F.lit("MMMM d, yyyy")), F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).cast("date")
    return df.select(day.alias("date"), clean_symbol(F.col("added")).alias("added"), clean_symbol(F.col("removed")).alias("removed")).where("date is not null")


def size_check(universe: DataFrame, sessions: DataFrame, expected: int, tolerance: int) -> DataFrame:
    """(date, members, off): sessions on which the index has too few or too many members."""
    days = sessions.select("date").distinct()
    m = F.broadcast(universe)
    joined = days.join(m, (m["start"].isNull() | (m["start"] <= days["date"])) & (m["end"].isNull() | (days["date"] < m["end"])), "left")
    return joined.groupBy("date").agg(F.count_distinct("ticker").alias("members")).withColumn("off", F.abs(F.col("members") - expected) > tolerance)


def log_density(changes: DataFrame, least: int) -> DataFrame:
    """(yr, changes, thin): years with fewer changes than an index has, where the log is likely incomplete."""
    return changes.groupBy(F.year("date").alias("yr")).agg(F.count("*").alias("changes")).withColumn("thin", F.col("changes") < least)
