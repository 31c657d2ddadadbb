"""Streams with state: positions of pairs as scores arrive, and a store that keeps the last row of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge.operators.states import PairMachine, PairRule
from panelforge.streaming.bars import latest


def stream_positions(scores: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """scores (y, x, i, z) of a stream, with pos and reason. Sessions of a pair must arrive in order, those of one micro-batch in any.

    The state of a pair is four numbers, whatever the length of its history.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = PairMachine(rule, *state.get) if state.exists else PairMachine(rule)
        rows = pd.concat(batches).sort_values("i")
        steps = [machine.step(None if pd.isna(z) else z) for z in rows["z"]]
        state.update((machine.position, machine.held, machine.barred_long, machine.barred_short))
        yield rows[["y", "x", "i", "z"]].assign(pos=[p for p, _ in steps], reason=[why for _, why in steps])

    return scores.select("y", "x", "i", "z").groupBy("y", "x").applyInPandasWithState(
        run, "y string, x string, i long, z double, pos int, reason int", "position int, held int, barred_long boolean, barred_short boolean", "append", GroupStateTimeout.NoTimeout
    )


def keep_last_into(path: str, keys: list[str], order: list[str], partition: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a store under path with one row a key, the last by `order`; a late row replaces an earlier one, and only the partitions that a batch touches are rewritten."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        rows = batch
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            touched = batch.select(partition).distinct()
            rows = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi").select(*batch.columns).unionByName(batch)
        scratch = f"{path}-batch"
        latest(rows, keys, order).write.mode("overwrite").parquet(scratch)  # what is read is replaced
        spark.read.schema(batch.schema).parquet(scratch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        batch.unpersist()

    return merge


def late_rows(batch: DataFrame, stored: DataFrame, keys: list[str], date: str, overlap_days: int) -> DataFrame:
    """Keys of rows that are older than the overlap before the key's last stored date: their history is to be read anew in full."""
    from pyspark.sql import functions as F

    last = stored.groupBy(*keys).agg(F.max(date).alias("_last"))
    return batch.join(last, keys).where(F.col(date) < F.date_sub("_last", overlap_days)).select(*keys).distinct()
