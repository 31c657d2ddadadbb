"""Price sources: CSV folders, a synthetic world, errors, retries and a factory. A fetch reads many tickers as one DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.sources.store import read_csv_prices

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double"
ACTIONS = "ticker string, date date, kind string, value double"


class SourceError(RuntimeError):
    """A source that will not answer, however often it is asked."""


class TransientSourceError(SourceError):
    """A source that may answer if asked again."""


@dataclass(frozen=True)
class History:
    """Prices and actions; empty ones are answers, not errors."""

    prices: DataFrame
    actions: DataFrame


class DataSource(Protocol):
    def fetch(self, spark: SparkSession, tickers: list[str], start: str, end: str) -> History:
        """Rows of these tickers from start to end, both included."""


@dataclass(frozen=True)
class CsvSource:
    """A folder of <ticker>.csv and, where there are any, <ticker>.actions.csv files."""

    folder: str

    def fetch(self, spark: SparkSession, tickers: list[str], start: str, end: str) -> History:
        prices = read_csv_prices(spark, self.folder, start, end).where(F.col("ticker").isin(tickers))
        rows = spark.read.schema("date date, kind string, value double").option("header", True).option("pathGlobFilter", "*.actions.csv").csv(self.folder)
        ticker = F.upper(F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.actions\.csv$", 1)))
        actions = rows.select(ticker.alias("ticker"), "date", "kind", "value").where(F.col("ticker").isin(tickers) & F.col("date").between(start, end))
        return History(prices, actions)


@dataclass(frozen=True)
class SyntheticSource:
    """A world of seeded prices: every ticker's log returns are hashes of its name and the session, splits halve the vendor's price."""

    seed: int = 7
    volatility: float = 0.015
    drift: float = 0.0003

    def fetch(self, spark: SparkSession, tickers: list[str], start: str, end: str) -> History:
        names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
        days = spark.sql(f"select explode(sequence(date '{start}', date '{end}')) as date").where("weekday(date) < 5")

        def uniform(salt: int):
            return (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), "ticker", "date"), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))

        normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
        path = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        rows = names.crossJoin(F.broadcast(days)).withColumn("close", 100 * F.exp(F.sum(self.drift + self.volatility * normal).over(path)))
        prices = rows.select("ticker", "date", (F.col("close") * 0.999).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", F.floor(1e6 * (0.5 + uniform(3))).cast("double").alias("volume"))
        first = F.row_number().over(W.partitionBy("ticker", F.date_trunc("quarter", "date")).orderBy("date"))
        actions = rows.withColumn("k", first).where("k = 1").select("ticker", "date", F.lit("dividend").alias("kind"), (F.col("close") * 0.005).alias("value"))
        return History(prices, actions)


def actions_of(prices: DataFrame) -> DataFrame:
    """Long rows of the vendor columns `dividends` and `splits` that are above 0."""
    long = prices.select("ticker", "date", F.expr("stack(2, 'dividend', dividends, 'split', splits) as (kind, value)"))
    return long.where("value > 0")


SOURCES: dict[str, Callable[..., DataSource]] = {"csv": CsvSource, "synthetic": SyntheticSource}


def make_source(kind: str, **settings) -> DataSource:
    if kind not in SOURCES:
        raise SourceError(f"no source {kind}")
    return SOURCES[kind](**settings)


def with_retry(ask: Callable, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """The answer of ask(), which is asked again after 1, 2, 4 ... 30 seconds at most while it fails for now."""
    for k in range(retries + 1):
        try:
            return ask()
        except TransientSourceError:
            if k == retries:
                raise
            sleep(min(2.0**k, 30.0))
