"""Sampled splitters: size-weighted key samples choose the boundaries of ranges, which become shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.shared import materialize


def _locate(key: Column, splitters: Column, n: int) -> Column:
    """How many of n ascending splitters are at most key, in two steps of about sqrt(n) comparisons."""
    step = max(1, int(n**0.5))
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit((n - 1) // step)), lambda i: F.get(splitters, i * step)), lambda s: s <= key))
    first = F.greatest(coarse - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(splitters, first + 1, step), lambda s: s <= key))


def range_shards(
    df: DataFrame,
    key: list[str],
    size: str,
    n_shards: int = 8,
    n_ranges: int = 1024,
    samples_per_range: int = 16,
    overfull: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Range-partition records so that the shards' total sizes are nearly equal.

    1. Each row is drawn as often as its size asks for, n_ranges *
       samples_per_range times the share that it has of all sizes, and once more
       with the chance that is left over; a seeded hash decides, so a repeated
       task draws the same rows.
    2. The quantiles of the sampled keys are the boundaries of n_ranges ranges.
    3. The ranges' true sizes are added up; one over `overfull` times the mean is
       subdivided by a hash of the first key column, and what is overfull still, as
       one such key is, by a hash of the whole key.
    4. Running totals, over the ranges and then within each, give every row its
       place on a line of all sizes, which is cut into n_shards equal lengths.

    Returns df's columns with shard (int), slot (long, gapless from 0 in a shard)
    and range_id (int). Two shards' sizes differ by at most about one row's size.
    A key with a third of all rows is spread over the ranges by the later key
    columns. Rows that are alike in key and size are interchangeable. Nulls in
    the key sort first; a null or negative size counts as 0; n_ranges bounds all
    that is broadcast or gathered. No rows give no rows. Columns of df called
    shard, slot or range_id are replaced, all others stay, whatever their names.
    """
    df = df.drop("shard", "slot", "range_id")
    weight = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    base = df.select(F.struct(*df.columns).alias("row"), F.struct(*key).alias("key"), weight.alias("size"))
    total, n_rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = F.col("size") * F.lit(n_ranges * samples_per_range / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(wanted).cast("int") + (draw < wanted - F.floor(wanted)).cast("int")
    sample = base.select("key", times.alias("times")).where("times > 0").select(F.explode(F.array_repeat("key", F.col("times"))).alias("key"))
    sample = sample.agg(F.array_sort(F.collect_list("key")).alias("s"))
    every = F.transform(F.sequence(F.lit(1), F.lit(n_ranges - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / n_ranges).cast("int")))
    splitters = materialize(sample.select(F.when(F.size("s") > 0, F.filter(every, lambda x: x.isNotNull())).otherwise(F.array().cast(sample.schema["s"].dataType)).alias("s")), "splitters")
    placed = base.crossJoin(F.broadcast(splitters)).withColumn("range_id", _locate(F.col("key"), F.col("s"), n_ranges - 1)).drop("s")

    def divided(placed: DataFrame, by: list[str], salt: int, column: str, name: str) -> DataFrame:
        """placed with the pieces that an overfull one falls into, by a hash of a column."""
        limit = overfull * max(1, total) / n_ranges, overfull * max(1, n_rows) / n_ranges
        sums = placed.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("bytes") / limit[0], F.col("rows") / limit[1]))).cast("int")
        parts = materialize(sums.select(*by, parts.alias("parts")), "ranges")
        piece = F.pmod(F.xxhash64(F.lit(seed + salt), column), F.col("parts")).cast("int")
        return placed.join(F.broadcast(parts), by).withColumn(name, piece).drop("parts")

    placed = materialize(divided(placed, ["range_id"], 1, f"key.`{key[0]}`", "piece"), "placed")
    pieces = ["range_id", "piece", "part"]
    placed = materialize(divided(placed, pieces[:2], 2, "key", "part"), "placed")
    # at most some n_ranges * (1 + 2 * overfull) parts, whatever the number of rows
    line = W.orderBy(*pieces)
    before = line.rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*pieces).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .select(*pieces, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("from"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    )
    inside = W.partitionBy(*pieces).orderBy("key", "size")
    middle = F.col("from") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    ranked = placed.join(F.broadcast(starts), pieces).select(
        "row", "range_id",
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, total)))).cast("int").alias("shard"),
        (F.col("rank") + F.row_number().over(inside) - 1).alias("rank"),
    )
    ranked = materialize(ranked, "ranked")
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select("row.*", "shard", (F.col("rank") - F.col("first")).alias("slot"), "range_id")
