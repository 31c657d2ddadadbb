"""Helpers that the operators share: tables, intermediate results, groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor sees: spark.checkpoint.dir.

    Where the setting is missing, a single machine gets a temporary folder; a
    cluster is an error, as its machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs only its own tasks.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the JVM has seen that no plan names them."""
    spark.sparkContext._jvm.System.gc()


#: Bits of the filter of among(): 4 MB on every machine.
AMONG_BITS = 25


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose key, a hash, may be in the column of wanted: all that are, and few others. It spares an exact join, which follows, the shuffle of most rows."""
    place = F.pmod(F.col(key), F.lit(1 << AMONG_BITS)) + 1  # the bitmap functions count from 1
    bucket, bit, bits = (free_name(x, rows.columns) for x in ("bucket", "bit", "bits"))
    found = wanted.select(F.col(wanted.columns[0]).alias(key)).select(place.alias("p"))
    found = found.groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    placed = rows.withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(bit, F.bitmap_bit_position(place).cast("int"))
    byte = f"cast(conv(hex(substring({bits}, {bit} div 8 + 1, 1)), 16, 10) as int)"
    return placed.join(F.broadcast(found), bucket).where(f"shiftright({byte}, {bit} % 8) & 1 = 1").select(*rows.columns)


def free_name(name: str, columns: list[str]) -> str:
    """A name for a helper column that none of the given ones has, whatever their case."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node of each.

    Contraction: every node takes the smallest of itself and its neighbours, the
    edges are rewritten to those and the loops dropped, until no edge is left.
    The edges at least halve with each round; a hub with a third of all edges is
    pre-aggregated before the shuffle, and its joins are ones that Spark can split.
    Nulls, loops and repeated edges do no harm; no edges give no rows.
    """
    left = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges"
    )
    maps = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("a").alias("low")).union(
            left.select(F.col("b").alias("node"), F.col("a").alias("low"))
        )
        step = both.groupBy("node").agg(F.min("low").alias("parent"))
        up = step.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        step = materialize(
            step.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")), "parents"
        )
        maps.append(step)
        pa, pb = (step.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        old = left
        left = materialize(
            left.join(pa, "a").join(pb, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct(),
            "edges",
        )
        drop(old)
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = maps[-1].select("node", F.col("parent").alias("component"))
    for step in reversed(maps[:-1]):
        out = step.join(out.withColumnRenamed("node", "parent"), "parent", "left").select(
            "node", F.coalesce("component", "parent").alias("component")
        )
    return materialize(out, "components") if len(maps) > 1 else out
