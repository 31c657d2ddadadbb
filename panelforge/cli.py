"""python -m panelforge.cli: universe, refresh, audit, survivorship, status."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelforge import config
from panelforge.sources import lifecycle, universe, vendors


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelforge", description=__doc__)
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("universe", "refresh", "audit", "survivorship", "status"):
        s = sub.add_parser(name)
        s.add_argument("--out", help="a folder for the report, as CSV")
        if name in ("refresh", "audit", "survivorship"):
            s.add_argument("--start", required=True)
            s.add_argument("--end", required=True)
        if name == "refresh":
            s.add_argument("--limit", type=int, help="only the first so many tickers")
            s.add_argument("--force", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, now: datetime | None = None) -> int:
    a = parser().parse_args(args)
    cfg = config.load(a.config)
    spark = spark or SparkSession.builder.getOrCreate()
    store = lifecycle.Store(spark, cfg.store)
    members = universe.static_universe(spark, cfg.tickers) if cfg.universe == "static" else universe.file_universe(spark, cfg.universe)
    if a.command == "universe":
        out = members.members
    elif a.command == "refresh":
        names = sorted(r["ticker"] for r in members.ever(a.start, a.end).collect())[: a.limit]
        source = vendors.make_source(cfg.source, **({"folder": cfg.folder} if cfg.source == "csv" else {}))
        out = lifecycle.refresh(store, source, names, a.start, a.end, now or datetime.now(timezone.utc).replace(tzinfo=None), cfg.refresh, a.force)
    elif a.command == "audit":
        out = lifecycle.summarize_issues(store.issues().where(F.col("first_date") <= a.end))
    elif a.command == "survivorship":
        first = store.prices().groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        out = members.ever(a.start, a.end).join(first, "ticker", "left").withColumn("priced", F.col("first_date").isNotNull())
    else:
        out = store.manifest().orderBy("ticker")
    if a.out:
        out.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)
    else:
        out.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
