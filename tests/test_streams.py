"""Stateful streams against their batch counterparts."""

import datetime

import numpy as np

from panelforge.operators.states import PairRule, walk_pair
from panelforge.streaming import stateful


def test_streamed_positions_are_those_of_the_batch(spark, tmp_path):
    rng, rule = np.random.default_rng(1), PairRule(1.5, 0.5, 3.0, 6)
    z = {p: np.cumsum(rng.normal(0, 0.8, 60)) * 0.6 for p in ("a", "b")}
    z["a"][20] = np.nan
    for part in range(3):  # three files, one micro-batch each
        rows = [(p, "x", i, None if np.isnan(v[i]) else float(v[i])) for p, v in z.items() for i in range(20 * part, 20 * part + 20)]
        spark.createDataFrame(rows, "y string, x string, i long, z double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("y string, x string, i long, z double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.stream_positions(stream, rule).writeStream.format("memory").queryName("positions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination(120)
    for p, v in z.items():
        got = [(r["pos"], r["reason"]) for r in spark.table("positions_out").where(f"y = '{p}'").orderBy("i").collect()]
        assert got == list(zip(*walk_pair(v.tolist(), rule)))


def test_the_last_row_of_a_key_stays(spark, tmp_path):
    merge = stateful.keep_last_into(f"{tmp_path}/out", ["k", "day"], ["seen"], "day")
    schema = "k string, v int, seen int, day string"
    merge(spark.createDataFrame([("a", 1, 1, "d1"), ("a", 2, 2, "d1"), ("b", 3, 1, "d2")], schema), 0)
    merge(spark.createDataFrame([("a", 9, 3, "d1"), ("c", 4, 1, "d1")], schema), 1)
    merge(spark.createDataFrame([("a", 0, 0, "d1")], schema), 2)
    assert sorted((r["k"], r["v"], str(r["day"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 9, "d1"), ("b", 3, "d2"), ("c", 4, "d1")]
    day = lambda d: datetime.date(2020, 1, d)
    stored = spark.createDataFrame([("a", day(20)), ("b", day(20))], "k string, d date")
    batch = spark.createDataFrame([("a", day(2)), ("b", day(15))], "k string, d date")
    assert [r["k"] for r in stateful.late_rows(batch, stored, ["k"], "d", 10).collect()] == ["a"]
