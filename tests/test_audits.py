"""Late rows, each row once, tables of buckets and rules over a stream's progress."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from strata.plans.stream_audits import in_drops
from strata.sources import buckets, versions
from strata.streaming import audit, health
from strata.streaming import events as st

HOUR = datetime.timedelta(hours=1)
T0 = datetime.datetime(2024, 1, 1)
ROWS = [(0, 1, T0), (0, 2, T0 + 5 * HOUR), (0, 3, None), (1, 4, T0 + 4 * HOUR), (1, 5, T0 + 3 * HOUR), (1, 6, T0 + 20 * HOUR), (2, 7, T0 + 19 * HOUR), (2, 8, T0 + 18 * HOUR), (2, 2, T0 + 5 * HOUR), (3, 9, T0)]


def test_audited_rows_are_those_that_spark_drops(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame(ROWS, "drop int, id int, ts timestamp")
    sink = audit.late_sink(root, "ts", HOUR, st.table_sink(f"{root}/accepted"))
    log = health.ProgressLog()
    spark.streams.addListener(log)

    def each(stream, k):
        st.run_available(stream, sink, f"{root}/c1")
        st.run_available(st.dedup_stream(stream, ["id"], "ts", "1 hour"), st.table_sink(f"{root}/kept"), f"{root}/c2")

    try:
        in_drops(rows, F.col("drop"), 4, root, each)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    log.write(spark, f"{root}/progress")
    report = {r.batch: (r.n_rows, r.n_late, r.worst_ms) for r in audit.late_report(spark, root, "ts").collect()}
    assert report == {0: (3, 0, None), 1: (3, 2, 3_600_000), 2: (3, 3, 14 * 3_600_000), 3: (1, 1, 19 * 3_600_000)}
    late = spark.read.parquet(f"{root}/late")
    assert sorted(r.id for r in late.collect()) == [2, 4, 5, 7, 8, 9]
    assert sorted(r.id for r in spark.read.parquet(f"{root}/accepted").collect()) == sorted(r.id for r in spark.read.parquet(f"{root}/kept").collect()) == [1, 2, 3, 6]
    assert spark.read.parquet(f"{root}/progress").agg(F.sum("late_rows")).collect()[0][0] == late.count()


def test_late_sink_replay(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame(ROWS, "drop int, id int, ts timestamp")
    sink = audit.late_sink(root, "ts", HOUR, st.table_sink(f"{root}/accepted"))
    for n in (0, 1, 1, 2, 1, 2):
        sink(rows.where(F.col("drop") == n), n)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/late").collect()) == [2, 4, 5, 7, 8]


@pytest.mark.parametrize("breaks", ["before the sink", "in the sink", "after the sink"])
def test_each_row_once_after_a_breakdown(spark, tmp_path, breaks):
    root, broken = str(tmp_path), []
    write = st.table_sink(f"{root}/out")

    def once(when, n):
        if when == breaks and n == 1 and not broken:
            broken.append(n)
            raise RuntimeError(when)

    def sink(batch, n):
        once("before the sink", n)
        write(batch.limit(2) if breaks == "in the sink" and n == 1 and not broken else batch, n)
        once("in the sink", n)

    def whole(batch, n):
        audit.ledger_sink(root, ["id"], sink)(batch, n)
        once("after the sink", n)

    def each(stream, k):
        try:
            st.run_available(stream, whole, f"{root}/c")
        except StreamingQueryException:
            seen.append(audit.exactly_once(spark, root, spark.read.parquet(f"{root}/out"), ["id"]).collect()[0])
            st.run_available(stream, whole, f"{root}/c")

    seen = []
    in_drops(spark.range(12), F.col("id") % 3, 3, root, each)
    assert broken == [1] and seen[0].unfinished == (breaks != "after the sink")
    assert seen[0].exactly_once == (breaks == "after the sink")
    got = audit.exactly_once(spark, root, spark.read.parquet(f"{root}/out"), ["id"]).collect()[0]
    assert tuple(got) == (3, 0, 12, 12, 12, True)


def test_ledger_finds_what_is_wrong(spark, tmp_path):
    root = str(tmp_path)
    sink = audit.ledger_sink(root, ["id"], st.table_sink(f"{root}/out"))
    sink(spark.range(5), 0)
    with pytest.raises(audit.ReplayDiffers):
        sink(spark.range(1, 6), 0)
    assert spark.read.parquet(f"{root}/out").count() == 5
    out = spark.read.parquet(f"{root}/out").select("id")
    for table, good in ((out, True), (out.union(out.limit(1)), False), (out.where("id > 0"), False), (out.where("id > 0").union(spark.createDataFrame([(9,)], "id long")), False)):
        assert audit.exactly_once(spark, root, table, ["id"]).collect()[0].exactly_once == good
    assert tuple(audit.exactly_once(spark, f"{root}/none", out.limit(0), ["id"]).collect()[0]) == (0, 0, 0, 0, 0, True)


SCHEMA = "k int, t int, v string"


def folders(spark, root):
    return {r.bucket: r.folder for r in buckets.manifest(spark, root).collect()}


def test_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    root = str(tmp_path)
    first = spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("t"), F.lit("a").alias("v"))
    assert buckets.merge_buckets(first, root, ["k"], ["t"], 16, "first") == 16
    before = folders(spark, root)
    change = spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (7, 0, "old"), (None, 1, "n"), (None, 2, "m"), (900, 1, "new")], SCHEMA)
    touched = {r[0] for r in change.select(buckets.bucket_of(["k"], 16)).collect()}
    assert buckets.merge_buckets(change, root, ["k"], ["t"], 99, "second") == len(touched) < 16
    after = folders(spark, root)
    assert {b for b in after if after[b] != before.get(b)} == touched
    for _ in range(2):  # a replay of either changes nothing
        assert buckets.merge_buckets(change, root, ["k"], ["t"], 16, "second") == buckets.merge_buckets(first, root, ["k"], ["t"], 16, "first") == 0
    got = {r.k: r.v for r in buckets.read_buckets(spark, root).collect()}
    assert buckets.read_buckets(spark, root).count() == len(got) == 202
    assert (got[5], got[7], got[None], got[900]) == ("c", "a", "m", "new")
    assert buckets.merge_buckets(change, root, ["k"], ["t"], note="again") == len(touched)  # null keys too are there once
    assert buckets.read_buckets(spark, root).count() == 202
    assert buckets.read_buckets(spark, root, version=1).count() == 200
    assert [r.v for r in buckets.lookup(spark, root, {"k": 5}).collect()] == ["c"] and buckets.lookup(spark, root, {"k": 5000}).isEmpty()
    assert [r.v for r in buckets.lookup(spark, root, {"k": None}).collect()] == ["m"]


def test_rebucket_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("t"), F.lit("a").alias("v"))
    with pytest.raises(LookupError):
        buckets.read_buckets(spark, root)
    assert buckets.merge_buckets(rows.limit(0), root, ["k"], ["t"]) == 0
    buckets.merge_buckets(rows, root, ["k"], ["t"], 4)
    buckets.merge_buckets(rows.where("k = 3"), root, ["k"], ["t"])
    assert buckets.vacuum(spark, root, 2) == 0 and buckets.vacuum(spark, root) == 1
    buckets.rebucket(spark, root, ["k"], 8)
    buckets.merge_buckets(rows.withColumn("t", F.lit(2)), root, ["k"], ["t"])
    assert buckets.read_buckets(spark, root).agg(F.count("*"), F.min("t")).collect()[0] == (50, 2)
    assert buckets.vacuum(spark, root) == 12 and buckets.read_buckets(spark, root).count() == 50
    assert versions.history(spark, f"{root}/manifest").count() == 4


def progress(spark, rows):
    """run, batch, duration, state, removed, seconds that the newest event is behind, offsets behind."""
    made = [(r, r, b, T0 + b * HOUR, 1, 1.0, ms, state, removed, 0, None, T0 + b * HOUR - datetime.timedelta(seconds=gap), off) for r, b, ms, state, removed, gap, off in rows]
    return spark.createDataFrame(made, health.PROGRESS)


def test_health_rules(spark):
    rows = [("grows", b, 10, 100 + b, 1, 0, 0) for b in range(6)] + [("keeps", b, 10, 50, 0, 0, 0) for b in range(6)] + [("slow", b, 5000 if b == 2 else 10, 0, 0, 0, 0) for b in range(6)]
    rows += [("behind", b, 10, 0, 0, 700 * (b + 1), 0) for b in range(6)] + [("steady", b, 10, 0, 0, 5000, 0) for b in range(6)] + [("unread", b, 10, 0, 0, 0, 200_000 if b > 3 else 0) for b in range(6)] + [("new", b, 10, b, 0, 9000 + b, 0) for b in range(3)]
    got = {(r.run, r.rule): r.fired for r in health.verdicts(health.health(progress(spark, rows), 1000, 4)).collect() if r.fired}
    assert got == {("grows", "state_grows"): 2, ("keeps", "no_removals"): 3, ("slow", "slow"): 1, ("behind", "falls_behind"): 3, ("unread", "falls_behind"): 2}


def test_listener_of_a_stream(spark, tmp_path):
    root, log = str(tmp_path), health.ProgressLog()
    spark.streams.addListener(log)
    try:
        in_drops(spark.range(30), F.col("id") % 3, 3, root, lambda s, k: st.run_available(s.dropDuplicates(["id"]), st.table_sink(f"{root}/out"), f"{root}/c"))
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    assert log.write(spark, f"{root}/p") >= 3 and log.write(spark, f"{root}/p") == 0
    got = spark.read.parquet(f"{root}/p")
    assert got.agg(F.sum("n_rows"), F.max("state_rows")).collect()[0] == (30, 30)
    flags = health.health(got.withColumn("run", F.lit("one")), 10**9, 2)
    assert flags.where("state_grows").count() == 1 and flags.where("no_removals").count() == 2 and flags.where("slow").isEmpty()
