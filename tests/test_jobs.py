import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import inspection
from strata.functions import udfs
from strata.operators import changes
from strata.plans import layers, marts
from strata.sources import versions
from strata.streaming import events as st
from strata.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def arrive(spark, path, parts, schema):
    """Writes parts one after another as files and gives the stream that reads one file a batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return st.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_session_paths_and_drafts(spark, tmp_path):
    parts = [[(1, at(0), "view", "a"), (1, at(60), "click", "b"), (1, at(9000), "view", None)], [(1, at(90_000), "odd", "c")]]
    schema = "user long, ts timestamp, kind string, page string"
    for drafts in (False, True):
        src, out = str(tmp_path / f"s{drafts}"), str(tmp_path / f"o{drafts}")
        df = jobs.session_paths(st.with_event_time(arrive(spark, src, parts, schema), "ts", "1 minute"), "user", "ts", "kind", "page", ["view", "click"], 1800, drafts)
        st.run_available(df, st.table_sink(out), str(tmp_path / f"c{drafts}"), "update" if drafts else "append")
        got = [(r.n_events, r.n_view, r.n_click, r.path) for r in spark.read.parquet(out).where("is_final").collect()]
        assert (2, 1, 1, ["a", "b"]) in got and (1, 1, 0, []) in got
        assert spark.read.parquet(out).where("NOT is_final").isEmpty() != drafts


def test_sessions_in_another_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        day = 1_700_000_000
        rows = [[(1, day, "view"), (1, day + 60, "click"), (2, day + 7000, "view")], [(3, day + 7300, "view")]]
        src = str(tmp_path / "s")
        for part in rows:
            spark.createDataFrame(part, "user long, at long, kind string").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
        stream = st.with_event_time(st.read_stream(spark, src, spark.read.parquet(src).schema), "ts", "1 minute")
        found = {"paths": jobs.session_paths(stream, "user", "ts", "kind", "kind", ["view"], 1800), "plain": st.sessionize(stream, "user", "ts", 1800)}
        for name, df in found.items():
            st.run_available(df, st.table_sink(str(tmp_path / name)), str(tmp_path / f"c{name}"))
            got = spark.read.parquet(str(tmp_path / name)).select("user_id", F.unix_seconds("session_start").alias("a"), F.unix_seconds("session_end").alias("b"), "n_events")
            assert [tuple(r) for r in got.collect()] == [(1, day, day + 60, 2)], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_profiles_of_nulls(spark):
    rows = [(1, at(0), None, 5.0), (1, at(1), None, 5.0), (1, at(2), "x", None), (2, at(0), None, None), (None, at(0), "y", 100.0)]
    df = spark.createDataFrame(rows, "u long, ts timestamp, place string, amount double")
    got = {r.u: (r.home, r.mean_amount, r.risk_tier) for r in marts.build_profiles(df, "u", "ts", "place", "amount", "2024-01-02").collect()}
    assert got == {1: ("x", 5.0, "low"), 2: (None, None, "low"), None: ("y", 100.0, "high")}
    assert marts.build_profiles(df.limit(0), "u", "ts", "place", "amount", "2024-01-02").isEmpty()


def test_history_and_alerts(spark, tmp_path):
    rows = [(1, k, at(60 * k), 10.0, "x") for k in range(5)] + [(1, 5, at(400), 1000.0, "y"), (2, 6, at(0), 5.0, None)]
    src, root = str(tmp_path / "s"), str(tmp_path / "r")
    stream = arrive(spark, src, [rows[:3], rows[3:]], "user long, event long, ts timestamp, amount double, place string")
    jobs.alert_job(jobs.track_history(st.with_event_time(stream, "ts", "1 hour"), "user", "event", "ts", "amount", "place"), jobs.behaviour_rules(), root, str(tmp_path / "c"))
    audit = {r.event_id: r for r in spark.read.parquet(f"{root}/audit").collect()}
    assert len(audit) == 7 and audit[0].mean_before is None and audit[4].n_recent == 5
    assert (audit[5].burst, audit[5].moved, audit[5].large, audit[5].level) == (True, True, True, "high")
    assert [r.event_id for r in spark.read.parquet(f"{root}/alerts").collect()] == [5]
    injected = spark.createDataFrame([(5, "move"), (6, "move"), (4, "burst")], "event_id long, pattern string")
    got = jobs.recall(spark.read.parquet(f"{root}/alerts"), injected, "event_id", "pattern")
    assert {r.pattern: r.recall for r in got.collect()} == {"move": 0.5, "burst": 0.0}


def test_cdc_job(spark, tmp_path):
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])

    def change(op, k, v, ts, lsn):
        side = {"id": k, "v": v}
        return (json.dumps({"before": side if op == "d" else None, "after": None if op == "d" else side, "op": op, "ts_ms": ts, "source": {"ts_ms": ts, "lsn": lsn, "table": "t"}}),)

    parts = [[change("c", 1, "a", 1, 1), change("u", 1, "b", 2, 2), change("c", 2, "x", 2, 3), (None,)], [change("d", 2, "x", 5, 5), change("u", 1, "late", 1, 0)]]
    stream = arrive(spark, str(tmp_path / "s"), parts, "value string")
    root = str(tmp_path / "r")
    for n in range(2):  # the second run, from the start, changes nothing
        jobs.cdc_job(stream, root, str(tmp_path / f"c{n}"), row, ["id"])
        assert [tuple(r) for r in jobs.replica(spark, root).collect()] == [(1, "b")]
    history = jobs.replica_history(spark, root, ["id"], ["v"])
    assert sorted((r.id, r.v, r.is_current) for r in history.collect()) == [(1, "a", False), (1, "b", True), (2, "x", False)]
    assert changes.check_scd2(history, ["id"]).isEmpty()


def test_bronze_stream(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    spark.createDataFrame([(b"k", b"v", "t", 0, n, T0, 0) for n in range(3)] + [(None, None, "t", 1, 0, T0, 0)], st.BROKER).write.parquet(src)
    for _ in range(2):
        jobs.bronze_stream(st.read_stream(spark, src, st.BROKER), out, str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == 4 and set(spark.read.parquet(out).columns) >= {"topic", "partition", "offset", "day"}


def test_stream_joins_of_all_kinds(spark, tmp_path):
    a = [[(1, at(0)), (2, at(0))], [(9, at(90_000))], [(9, at(180_000))]]
    b = [[(1, at(60)), (3, at(60))], [(9, at(90_000))], [(9, at(180_000))]]
    want = {"inner": 3, "left": 4, "right": 4, "full": 5, "left_semi": 3}
    for how, n in want.items():
        left = arrive(spark, str(tmp_path / f"a{how}"), a, "k long, a_ts timestamp")
        right = arrive(spark, str(tmp_path / f"b{how}"), b, "k long, b_ts timestamp")
        joined = st.interval_join(left, right, "k", "a_ts", "b_ts", "10 minutes", ("1 minute", "1 minute"), how)
        out = str(tmp_path / f"o{how}")
        st.run_available(joined, st.table_sink(out), str(tmp_path / f"c{how}"))
        assert spark.read.parquet(out).count() == n, how


def test_refreshing(spark):
    clock, loads = [0.0], []
    table = jobs.Refreshing(lambda: loads.append(1) or spark.range(len(loads)), 10, lambda: clock[0])
    assert [table().count(), table().count()] == [1, 1]
    clock[0] = 10.0
    assert table().count() == 2 and len(loads) == 2


def test_outbox(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert jobs.outbox(df, root, "k") == 1 and jobs.outbox(df.where("k = 1"), root, "k") == 2
    assert jobs.pending(spark, root, 2).isEmpty()
    assert [(r.version, r.key, json.loads(r.value)) for r in jobs.pending(spark, root, 1).collect()] == [(2, "1", {"k": 1, "v": "a"})]
    assert versions.read_version(spark, root).count() == 1


def test_lag_and_reconciliation(spark):
    progress = [{"batchId": 3, "eventTime": {"max": "2024-01-01T00:00:00.000Z"}, "sources": [{"endOffset": '{"t": {"0": 5, "1": 7}}', "latestOffset": {"t": {"0": 9, "1": 7}}}]}]
    got = jobs.lag_report(spark, progress, "2024-01-01 00:01:00+00:00").collect()
    assert sorted((r.partition, r.lag, r.seconds_behind) for r in got) == [(0, 4, 60.0), (1, 0, 60.0)]
    a = spark.createDataFrame([("d1", 1.0), ("d1", 2.0), ("d2", 1.0)], "day string, x double")
    same = {r.day: r.agrees for r in jobs.reconcile_day(a, a.where("x = 1 OR day = 'd3'"), "day", [], "x").collect()}
    assert same == {"d1": False, "d2": True}


def test_layers_once_and_again(spark, tmp_path):
    d, root = "/root/testdata/sf0.001", str(tmp_path / "m")
    layers.run_medallion(spark, d, root)
    once = sorted(map(tuple, layers.gold(spark, root).collect()), key=str)
    day = once[len(once) // 2][0]
    layers.load_day(spark, root, str(day))
    layers.backfill(spark, root, str(once[0][0]), str(day))
    assert sorted(map(tuple, layers.gold(spark, root).collect()), key=str) == once


def test_plan_facts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_custkey = 5").groupBy("o_orderstatus").agg(F.sum("o_totalprice"))
    facts = inspection.plan_facts(df)
    assert "EqualTo(o_custkey,5)" in facts["pushed_filters"][0] and "o_orderdate" not in facts["read_schema"][0]
    assert facts["exchanges"] == 1 and facts["joins"] == [] and facts["python"] == []


def test_event_log(spark, tmp_path):
    task = lambda stage, ms: {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Launch Time": 0, "Finish Time": ms}, "Task Metrics": {"Disk Bytes Spilled": 1}}
    log = [task(1, 10), task(1, 10), task(1, 50), {"Event": "SparkListenerExecutorAdded", "Executor ID": "1", "Timestamp": 0, "Executor Info": {"Total Cores": 4}}, {"Event": "SparkListenerExecutorAdded", "Executor ID": "2", "Timestamp": 0, "Executor Info": {"Total Cores": 2}}, {"Event": "SparkListenerExecutorRemoved", "Executor ID": "1", "Timestamp": 1_800_000}, {"Event": "SparkListenerApplicationEnd", "Timestamp": 3_600_000}]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, log)))
    r = inspection.task_report(spark, str(tmp_path / "log")).collect()[0]
    assert (r.stage_id, r.n_tasks, r.median_ms, r.max_ms, r.skew, r.spilled_bytes) == (1, 3, 10, 50, 5.0, 3)
    assert {r.executor: (r.core_hours, r.cost) for r in inspection.core_hours(spark, str(tmp_path / "log"), 0.5).collect()} == {"1": (2.0, 1.0), "2": (2.0, 1.0)}


def test_haversine(spark):
    df = spark.createDataFrame([(52.52, 13.405, 48.8566, 2.3522), (0.0, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(udfs.haversine_km("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(877.5, abs=1) and got[1] == 0 and (got[2] is None or got[2] != got[2])
