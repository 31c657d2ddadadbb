"""Sources, refresh, universes, registry, configuration and command line."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from panelforge import cli, config
from panelforge.research import registry
from panelforge.sources import lifecycle, universe, vendors

D = datetime.date


def test_sanitize(spark):
    rows = [("A", D(2020, 1, 2), 1.0, 1.0, 1.0, 10.0, 5.0, 0), ("A", D(2020, 1, 2), 1.0, 1.0, 1.0, 11.0, 5.0, 1), ("A", D(2020, 1, 3), None, 1.0, 1.0, 12.0, -1.0, 2), ("A", D(2020, 1, 6), None, 1.0, 1.0, 12.0, 1.0, 3), ("A", D(2020, 1, 7), 1.0, 1.0, 1.0, 0.0, 1.0, 4), ("A", D(2020, 1, 8), 1.0, 1.0, 1.0, float("nan"), 1.0, 5)]
    clean, issues = lifecycle.sanitize(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, arrival int"))
    got = clean.orderBy("date").collect()
    assert [(r["close"], r["volume"]) for r in got] == [(11.0, 5.0), (12.0, None), (12.0, 1.0)]
    assert {r["code"]: r["count"] for r in issues.collect()} == {"duplicate_dates": 1, "bad_close": 2, "negative_volume": 1, "partial_bars": 1}
    assert lifecycle.summarize_issues(issues).first()["code"] == "bad_close"
    acts = spark.createDataFrame([("A", D(2020, 1, 2), "split", 2.0, 0), ("A", D(2020, 1, 2), "split", 3.0, 1), ("A", D(2020, 1, 3), "gift", 1.0, 2), ("A", D(2020, 1, 3), "dividend", 0.0, 3)], "ticker string, date date, kind string, value double, arrival int")
    assert [r["value"] for r in lifecycle.sanitize_actions(acts).collect()] == [3.0]
    assert spark.createDataFrame([("2020-01-02T23:30:00-05:00",)], "t string").select(lifecycle.naive_dates("t")).first()[0] == D(2020, 1, 2)


def test_plan_has_every_branch(spark):
    now, end = datetime.datetime(2020, 7, 1), D(2020, 6, 30)
    t = lambda days: now - datetime.timedelta(days=days)
    rows = [
        ("gone", "no_data", None, None, t(3), None, None), ("back", "no_data", None, None, t(40), None, None), ("failed", "failed", None, None, t(1), None, None), ("old", "ok", D(2020, 1, 1), D(2020, 6, 1), t(1), t(400), None),
        ("done", "ok", D(2020, 1, 1), end, t(1), t(20), None), ("ended", "ok", D(2020, 1, 1), D(2020, 3, 1), t(1), t(20), t(5)), ("more", "ok", D(2020, 1, 1), D(2020, 6, 25), t(1), t(20), t(5)),
    ]
    m = spark.createDataFrame(rows, "ticker string, status string, first_date date, last_date date, last_attempt_at timestamp, last_full_at timestamp, last_empty_at timestamp")
    names = spark.createDataFrame([(r[0],) for r in rows] + [("new",)], "ticker string")
    got = {r["ticker"]: (r["mode"], r["reason"]) for r in lifecycle.plan_refresh(m, names, end, now).collect()}
    assert got == {
        "gone": ("skip", "no data, retried recently"), "back": ("full", "retry after no data"), "failed": ("full", "previous attempt failed"), "old": ("full", "periodic"), "done": ("skip", "up to date"),
        "ended": ("skip", "ended, probed recently"), "more": ("incremental", "new sessions"), "new": ("full", "new ticker"),
    }
    assert {r["mode"] for r in lifecycle.plan_refresh(m, names, end, now, force=True).collect()} == {"full"}


def _folder(path, closes):
    path.mkdir(exist_ok=True)
    for t, rows in closes.items():
        (path / f"{t}.csv").write_text("date,open,high,low,close,volume\n" + "".join(f"{d},{c},{c},{c},{c},100\n" for d, c in rows))
    (path / "aaa.actions.csv").write_text("date,kind,value\n2020-01-03,dividend,0.5\n")


def test_refresh_in_full_then_incrementally_then_restated(spark, tmp_path):
    days = [f"2020-01-{d:02d}" for d in (2, 3, 6, 7, 8)]
    _folder(tmp_path / "csv", {"aaa": [(d, 10 + k) for k, d in enumerate(days[:3])], "bbb": [(d, 20 + k) for k, d in enumerate(days[:3])]})
    where, source = lifecycle.Store(spark, str(tmp_path / "store")), vendors.make_source("csv", folder=str(tmp_path / "csv"))
    run = lambda end, day: {r["ticker"]: (r["mode"], r["status"], r["rows"]) for r in lifecycle.refresh(where, source, ["AAA", "BBB", "CCC"], "2020-01-01", end, datetime.datetime(2020, 1, day)).collect()}
    assert run("2020-01-06", 7) == {"AAA": ("full", "ok", 3), "BBB": ("full", "ok", 3), "CCC": ("full", "no_data", 0)}
    assert where.actions().count() == 1 and where.lookup("CCC")["status"] == "no_data" and where.lookup("ZZZ") is None
    _folder(tmp_path / "csv", {"aaa": [(d, 10 + k) for k, d in enumerate(days)], "bbb": [(d, 2 * (20 + k)) for k, d in enumerate(days)]})
    assert run("2020-01-08", 9) == {"AAA": ("incremental", "ok", 5), "BBB": ("full", "ok", 5), "CCC": ("skip", "skipped", 0)}
    assert {(r["ticker"], r["close"]) for r in where.prices().where("date = '2020-01-08'").collect()} == {("AAA", 14.0), ("BBB", 48.0)}
    assert where.prices().count() == 10 and where.log().count() == 6 and len(lifecycle.fingerprint(where.prices())) == 16


def test_sources(spark):
    world = vendors.make_source("synthetic", seed=3)
    a, b = (world.fetch(spark, ["AAA", "BBB"], "2020-01-01", "2020-03-31") for _ in range(2))
    assert a.prices.count() == 2 * 65 and a.prices.exceptAll(b.prices).count() == 0 and a.actions.count() == 2
    wide = spark.createDataFrame([("A", D(2020, 1, 2), 0.0, 2.0), ("A", D(2020, 1, 3), 0.5, 0.0)], "ticker string, date date, dividends double, splits double")
    assert {(r["kind"], r["value"]) for r in vendors.actions_of(wide).collect()} == {("split", 2.0), ("dividend", 0.5)}
    with pytest.raises(vendors.SourceError):
        vendors.make_source("ftp")
    waits, answers = [], iter([vendors.TransientSourceError(), vendors.TransientSourceError(), 7])

    def ask():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert vendors.with_retry(ask, 3, waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(vendors.TransientSourceError):
        vendors.with_retry(lambda: (_ for _ in ()).throw(vendors.TransientSourceError()), 1, waits.append)


def test_reconstruct(spark):
    current = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    log = spark.createDataFrame([(D(2020, 1, 10), "C", "D"), (D(2019, 5, 1), "B", "E"), (D(2018, 1, 1), "X", "A")], "date date, added string, removed string")
    intervals, anomalies = universe.reconstruct(current, log)
    u = universe.Universe(intervals.withColumn("sector", F.lit(None).cast("string")))
    on = lambda d: {r["ticker"] for r in u.on(d).collect()}
    assert on("2019-04-30") == {"A", "D", "E"} and on("2020-01-09") == {"A", "B", "D"} and on("2020-01-10") == {"A", "B", "C"}
    assert {(r["ticker"], r["anomaly"]) for r in anomalies.collect()} == {("X", "added_but_not_member_afterwards"), ("A", "removed_but_member_afterwards")}
    assert {r["ticker"] for r in u.ever("2019-06-01", "2019-12-31").collect()} == {"A", "B", "D"}
    days = spark.createDataFrame([(D(2019, 4, 30),), (D(2020, 1, 10),)], "date date")
    assert {r["members"] for r in universe.size_check(intervals, days, 3, 0).collect()} == {3}
    assert {r["yr"]: r["thin"] for r in universe.log_density(log, 1).collect()} == {2020: False, 2019: False, 2018: False}


def test_pages_and_builders(spark, tmp_path):
    page = "<table><tr><th>Symbol</th><th>GICS Sector</th></tr><tr><td>BRK.B[1]</td><td>Financials</td></tr><tr><td>N/A</td><td>x</td></tr></table><table><tr><th>Date</th><th>Added</th><th>Removed</th></tr><tr><td>June 1, 2020</td><td>fb</td><td>—</td></tr><tr><td>Ticker</td><td>x</td><td>y</td></tr></table>"
    current, log = universe.constituents(spark, page), universe.change_log(spark, page)
    assert [tuple(r) for r in current.collect()] == [("BRK-B", "Financials")] and [tuple(r) for r in log.collect()] == [(D(2020, 6, 1), "FB", None)]
    (tmp_path / "alias.csv").write_text("old,new\n# renamed\nfb,META\n")
    u, anomalies = universe.build_universe("index", current=current, changes=log, aliases=universe.load_aliases(spark, str(tmp_path / "alias.csv")))
    assert [r["ticker"] for r in anomalies.collect()] == ["META"] and [r["sector"] for r in u.members.collect()] == ["Financials"]
    (tmp_path / "u.csv").write_text("ticker,start,end\nabc,2019-01-01,\nxyz,,2019-06-30\n")
    f = universe.build_universe("file", spark=spark, path=str(tmp_path / "u.csv"))
    assert {r["ticker"] for r in f.on("2020-01-01").collect()} == {"ABC"} and {r["sector"] for r in f.sectors(f.on("2019-02-01")).collect()} == {"Unknown"}
    assert universe.build_universe("static", spark=spark, tickers=["a"]).caveat


def test_registry_holdout_and_reports(tmp_path):
    r = registry.Registry(tmp_path / "r.jsonl")
    a = r.append("pairs", {"entry": 2, "exit": 0.5}, {"sharpe": 0.3})
    assert a == r.append("pairs", {"exit": 0.5, "entry": 2}) and r.append("pca", {"k": 1}) != a
    assert (r.count_trials(), r.count_trials("pairs"), len(r.scan())) == (2, 1, 3) and "| pairs |" in r.markdown()
    h = registry.Holdout(tmp_path / "h.jsonl", D(2019, 1, 1))
    h.check(D(2018, 12, 31))
    with pytest.raises(registry.HoldoutError):
        h.check(D(2018, 12, 31), D(2019, 1, 1))
    h.unlock("final run")
    h.check(D(2020, 1, 1))
    with pytest.raises(registry.HoldoutError):
        registry.Holdout(tmp_path / "h.jsonl", D(2019, 1, 1)).unlock("again")
    registry.write_atomic(tmp_path / "one.json", json.dumps({"a": {"b": 1.234, "c": [5e6]}}))
    numbers = registry.headline_numbers(registry.load_results(tmp_path, ["one"]))
    assert registry.render("{{one.a.b|.1f}} {{one.a.c.0|money}}", numbers) == "1.2 $5.00M"
    with pytest.raises(KeyError):
        registry.render("{{nothing}}", numbers)


def test_config_and_cli(spark, tmp_path, capsys):
    _folder(tmp_path / "csv", {"aaa": [("2020-01-02", 10), ("2020-01-03", -1)]})
    text = f"store: {tmp_path}/store\nfolder: {tmp_path}/csv\ntickers: [aaa, zzz]\nsplit: {{holdout: 2020-06-01}}\nrefresh: {{retries: 1}}\n"
    (tmp_path / "c.yaml").write_text(text)
    cfg = config.load(tmp_path / "c.yaml")
    assert cfg.split.phase_of(D(2020, 6, 1)) == "holdout" and cfg.split.phase_of(D(2017, 1, 1)) == "validation" and cfg.refresh.retries == 1
    (tmp_path / "bad.yaml").write_text("stores: x\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.yaml")
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark, datetime.datetime(2020, 1, 6))
    assert run("refresh", "--start", "2020-01-01", "--end", "2020-01-03") == 0 and run("status") == 0 and run("universe") == 0
    assert run("audit", "--start", "2020-01-01", "--end", "2020-12-31", "--out", str(tmp_path / "audit")) == 0 and run("survivorship", "--start", "2020-01-01", "--end", "2020-12-31") == 0
    assert "no_data" in capsys.readouterr().out and spark.read.option("header", True).csv(str(tmp_path / "audit")).first()["code"] == "bad_close"
