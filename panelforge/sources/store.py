"""Sources and a store: price files by ticker, Parquet by ticker, a manifest, snapshots, append-only logs, HTML tables."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.streaming.bars import latest

PRICE_SCHEMA = "date date, open double, high double, low double, close double, volume double"


def read_csv_prices(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """Prices of a folder of <ticker>.csv files, both ends included; <ticker>.actions.csv files are left out."""
    df = spark.read.schema(PRICE_SCHEMA).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    df = df.select(F.upper(F.url_decode(name)).alias("ticker"), "*")
    return df.where(~F.col("ticker").endswith(".ACTIONS") & F.col("date").between(start, end))


def write_prices(df: DataFrame, path: str) -> None:
    """Replace the partitions of the tickers in df, and no others."""
    df.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def read_prices(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """The stored prices; a list of tickers prunes partitions."""
    df = spark.read.parquet(path)
    return df if tickers is None else df.where(F.col("ticker").isin(tickers))


def append(df: DataFrame, path: str) -> None:
    """Append to a log: fetches, issues, manifest rows."""
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest row of each ticker; rows carry `written`."""
    return latest(spark.read.parquet(path), ["ticker"], ["written"])


def write_snapshot(df: DataFrame, path: str, label: str) -> None:
    """A snapshot under its label."""
    df.write.mode("errorifexists").parquet(f"{path}/label={label}")


def read_snapshot(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """The snapshot of a label, else of the greatest one."""
    df = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("label", F.col("label").cast("string"))
    if label is None:
        label = df.agg(F.max("label")).head()[0]
    return df.where(F.col("label") == F.lit(label)).drop("label")


def content_hash(df: DataFrame, key: str = "ticker") -> DataFrame:
    """A hash of each key's rows, whatever their order, without collecting them: sums of row hashes and a count."""
    rest = sorted(c for c in df.columns if c != key)
    row = F.xxhash64(*rest)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).select(
        key, F.sha2(F.concat_ws(":", "n", "s", "x"), 256).alias("hash")
    )


class _Cells(HTMLParser):
    """Rows of cell texts of every table of a page."""

    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_table(html: str, wanted: list[str]) -> list[dict[str, str]]:
    """Rows of the first table whose header has all wanted columns; an error if none has."""
    parser = _Cells()
    parser.feed(html)
    for rows in parser.tables:
        if rows and set(wanted) <= set(rows[0]):
            return [dict(zip(rows[0], r)) for r in rows[1:] if r]
    raise ValueError(f"no table with the columns {wanted}")
