"""Store round trips, and streams against batches."""

import pytest

from panelforge.sources import store
from panelforge.streaming.bars import hourly_bars, latest

SF = "/root/testdata/sf0.001"


def test_store(spark, tmp_path):
    path = f"{tmp_path}/prices"
    rows = [("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 5.0)]
    store.write_prices(spark.createDataFrame(rows, "ticker string, i int, close double"), path)
    store.write_prices(spark.createDataFrame([("A", 3, 9.0)], "ticker string, i int, close double"), path)
    got = sorted((r.ticker, r.i, r.close) for r in store.read_prices(spark, path).collect())
    assert got == [("A", 3, 9.0), ("B", 1, 5.0)]
    assert store.read_prices(spark, path, ["B"]).count() == 1
    store.append(spark.createDataFrame([("A", 1), ("B", 1)], "ticker string, written int"), f"{tmp_path}/m")
    store.append(spark.createDataFrame([("A", 2)], "ticker string, written int"), f"{tmp_path}/m")
    assert sorted(map(tuple, store.manifest(spark, f"{tmp_path}/m").collect())) == [("A", 2), ("B", 1)]


def test_csv_and_snapshots(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/brk-b.csv").write_text("date,open,high,low,close,volume\n2020-01-02,1,2,1,2,10\n2020-01-03,1,2,1,3,10\n")
    (tmp_path / "csv/brk-b.actions.csv").write_text("date,kind,value\n2020-01-02,split,2\n")
    df = store.read_csv_prices(spark, f"{tmp_path}/csv", "2020-01-03", "2020-01-31")
    assert [(r.ticker, r.close) for r in df.collect()] == [("BRK-B", 3.0)]
    for label in ("2020-01-01", "2020-02-01"):
        store.write_snapshot(spark.createDataFrame([(label,)], "v string"), f"{tmp_path}/snap", label)
    assert store.read_snapshot(spark, f"{tmp_path}/snap").head()[0] == "2020-02-01"
    a = spark.createDataFrame([("A", 1), ("A", 2)], "ticker string, v int")
    assert store.content_hash(a).collect() == store.content_hash(a.orderBy("v", ascending=False)).collect()


def test_html_table():
    html = "<table><tr><th>X</th></tr></table><table><tr><th>Symbol</th><th>Sector</th></tr><tr><td>A <b>B</b></td><td>y</td></tr></table>"
    assert store.html_table(html, ["Symbol"]) == [{"Symbol": "A B", "Sector": "y"}]
    with pytest.raises(ValueError):
        store.html_table(html, ["Date"])


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = hourly_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = sorted(map(tuple, spark.table("bars_out").collect())), sorted(map(tuple, hourly_bars(events).collect()))
    assert got == want and len(got) > 100


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 3)], "k string, o int, v int")
    assert sorted(map(tuple, latest(df, ["k"], ["o"]).collect())) == [("a", 2, 4), ("b", 1, 3)]
