import datetime

import pytest
from pyspark.sql import functions as F

from strata.operators import changes, joins, quality, windows
from strata.sources import buckets, files, sinks, versions
from strata.streaming import events as st


def test_split_of_corrupt_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,day\n1,2.5,2024-01-01\n2,x,2024-01-02\n3,1.0\n\n4,4.0,2024-01-03,extra\n5,,\n")
    from pyspark.sql.types import DateType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([StructField("id", IntegerType()), StructField("amount", DoubleType()), StructField("day", DateType())])
    good, bad, n = files.read_split(spark, str(tmp_path / "a.csv"), schema, "run")
    assert n == {"total": 5, "corrupt": 3, "good": 2}
    assert sorted(r.id for r in good.collect()) == [1, 5] and bad.count() == 3
    raw, _, loose = files.read_split(spark, str(tmp_path / "a.csv"), files.raw_schema(["id", "amount", "day"]))
    assert loose["corrupt"] == 2
    inferred = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "a.csv")).schema
    assert {r.column for r in files.schema_diff(spark, inferred, schema).collect()} >= {"amount"}


def test_partition_reload_leaves_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("k"))
    sinks.write_partitioned(df, path, ["k"])
    for _ in range(2):
        sinks.overwrite_partitions(df.where("k = 3").withColumn("id", F.col("id") + 1000), path, ["k"])
    got = files.read_partitioned(spark, path, ["id", "k"])
    assert got.count() == 100 and got.where("id >= 1000").count() == 20
    assert sinks.file_stats(spark, path).count() == 5
    sinks.compact(spark, path, str(tmp_path / "c"), [], 1 << 20, ["id"])
    assert quality.same_rows(got.select("id"), spark.read.parquet(str(tmp_path / "c")).select("id"))
    sinks.rebuild(df.where("k = 1"), path, ["k"])
    assert files.read_partitioned(spark, path, ["id", "k"]).count() == 20


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    a, b = spark.range(3), spark.range(5)
    assert [versions.publish(a, root), versions.publish(b, root)] == [1, 2]
    with pytest.raises(versions.AuditFailed):
        versions.publish_if(a, root, lambda df: df.count() - 5)
    assert versions.read_version(spark, root).count() == 5
    assert versions.read_version(spark, root, 1).count() == 3
    assert versions.rollback(spark, root, 1) == 3 and versions.read_version(spark, root).count() == 3
    assert [r.added_rows for r in versions.history(spark, root).orderBy("version").collect()] == [3, 2, -2]
    assert versions.expire(spark, root, datetime.datetime(2100, 1, 1)) == 1
    assert versions.read_version(spark, root).count() == 3


def test_changes_twice_are_changes_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, "x", "u", 1, 1), (1, "y", "u", 1, 2), (2, None, "d", 1, 3), (9, None, "d", 1, 4), (4, "n", "c", 2, 5)], "k int, v string, op string, ts_ms long, lsn long")
    once = changes.apply_changes(target, log, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "y"), (3, "c"), (4, "n")]
    assert quality.same_rows(once, changes.apply_changes(once, log, ["k"]))
    history = changes.scd2_from_changes(log.union(log), ["k"], ["v"])
    assert quality.same_rows(history, changes.scd2_from_changes(log, ["k"], ["v"])) and changes.check_scd2(history, ["k"]).isEmpty()


def test_scd2_days(spark):
    dim = spark.createDataFrame([], "k int, v string, valid_from date, valid_to date, is_current boolean")
    for day, rows in (("2024-01-01", [(1, "a"), (2, None)]), ("2024-01-02", [(1, "b"), (2, None)]), ("2024-01-03", [(1, "b"), (2, "x")])):
        dim = changes.scd2_apply(dim, spark.createDataFrame(rows, "k int, v string"), ["k"], ["v"], day)
    assert sorted((r.k, r.v or "", str(r.valid_from), str(r.valid_to)[:4], r.is_current) for r in dim.collect()) == [(1, "a", "2024-01-01", "2024", False), (1, "b", "2024-01-02", "9999", True), (2, "", "2024-01-01", "2024", False), (2, "x", "2024-01-03", "9999", True)]


def test_salted_join_is_a_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.lit(1)).otherwise(F.col("id") % 7).alias("k"), "id")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k long, name string")
    plain = big.join(dim, "k").select("k", "id", "name")
    assert quality.same_rows(plain, joins.salted_join(big, dim, "k", 8).select("k", "id", "name"))
    assert quality.same_rows(plain, joins.hot_cold_join(big, dim, "k", [1]).select("k", "id", "name"))
    with pytest.raises(joins.DuplicateKeys):
        joins.assert_unique(dim.union(dim), ["k"])


def test_quarantine_and_gate(spark):
    df = spark.createDataFrame([(1, "F", 5.0), (2, None, -1.0), (3, "X", None)], "k int, s string, p double")
    rules = {"status": ~F.col("s").isin("F"), "price": F.col("p") < 0}
    clean, bad = quality.split_quarantine(df, rules)
    assert clean.count() + bad.count() == df.count() and {r.k: r.reasons for r in bad.collect()} == {2: ["price"], 3: ["status"]}
    report = quality.qc_report(df, "t", rules)
    with pytest.raises(quality.GateClosed):
        quality.enforce(report, {"status": None})
    assert sorted(quality.enforce(report, {"status": None, "price": 50.0})) == ["price", "status"]


def test_windows_on_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 5, None)], "k int, t int, v string")
    assert {r.k: r.v for r in windows.latest_per_key(df, ["k"], ["t"], ["v"]).collect()} == {1: "b", 2: None}
    assert sorted(r.place for r in windows.global_rank(spark.range(500).withColumn("x", F.col("id") % 3), "x", "id", n=7).collect()) == list(range(1, 501))


def test_stream_sessions_and_restart(spark, tmp_path):
    rows = [(1, 0), (1, 100), (1, 5000), (2, 50), (1, 90_000), (2, 90_000)]
    t0 = datetime.datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for n, part in enumerate((rows[:4], rows[4:], [(9, 500_000)])):
        spark.createDataFrame([(u, t0 + datetime.timedelta(seconds=s)) for u, s in part], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        df = st.read_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
        st.run_available(st.sessionize(st.with_event_time(df, "ts", "10 minutes"), "user_id", "ts", 1800), st.table_sink(out), cp)
    got = spark.read.parquet(out).collect()
    assert sorted((r.user_id, r.n_events) for r in got) == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1)]


def test_upsert_sink_replay(spark, tmp_path):
    root = str(tmp_path / "u")
    sink = st.upsert_sink(root, ["k"], ["t"])
    first, second = (spark.createDataFrame(r, "k int, t int, v string") for r in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "d")]))
    for df, n in ((first, 0), (second, 1), (second, 1)):
        sink(df, n)
    assert sorted((r.k, r.v) for r in buckets.read_buckets(spark, root).collect()) == [(1, "c"), (2, "d")]
    assert versions.history(spark, f"{root}/manifest").count() == 2


def test_global_rank_over_many_small_ranges(spark):
    """Ranges are sampled and merged anew for each plan; every row has one place all the same."""
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1024"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.range(60_000).select("id", (F.xxhash64("id") % 1_000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
        got = windows.global_rank(df, "v", "id").select("id", "v", "place").toPandas().sort_values("place")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got["place"].tolist() == list(range(1, 60_001))
    assert got[["v", "id"]].values.tolist() == got.sort_values(["v", "id"], ascending=[False, True])[["v", "id"]].values.tolist()


def test_compaction_by_key_follows_the_target(spark, tmp_path):
    path, to = str(tmp_path / "t"), str(tmp_path / "c")
    df = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"), F.when(F.col("id") < 30_000, 1).otherwise(2).alias("k"))
    df.repartition(20).write.partitionBy("k").parquet(path)
    size = sum(r["bytes"] for r in sinks.file_stats(spark, path).collect())
    sinks.compact(spark, path, to, ["k"], size // 6, ["id"])
    files_of = {r.k: r.n for r in spark.read.parquet(to).select("k", F.col("_metadata.file_path").alias("f")).distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert 3 <= files_of[1] <= 6 and 1 <= files_of[2] <= 3
    assert quality.same_rows(spark.read.parquet(to).select("id", "k"), df.select("id", "k"))


def test_upsert_refuses_several_rows_a_key(spark):
    target, two = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (1, "c")]))
    with pytest.raises(joins.DuplicateKeys):
        changes.upsert(target, two, ["k"])
    stays = changes.scd1_apply(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "x"), (3, "n")], "k int, v string"), ["k"])
    assert sorted(map(tuple, stays.collect())) == [(1, "a"), (2, "x"), (3, "n")]


def test_late_rows_are_dropped(spark, tmp_path):
    """Sliding windows over several batches with a watermark: what is late within the delay counts, what is later does not."""
    src = tmp_path / "in"
    src.mkdir()
    batches = [[(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:20:00")], [(3, "2024-01-01 10:12:00"), (4, "2024-01-01 10:45:00")], [(6, "2024-01-01 11:30:00")], [(5, "2024-01-01 10:01:00")], [(7, "2024-01-01 12:30:00")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(src / f"b{k}"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    import os
    import time

    for k in range(len(batches)):
        part = next(p for p in sorted((src / f"b{k}").iterdir()) if p.suffix == ".parquet")
        shutil.copy(part, flat / f"{k}.parquet")
        os.utime(flat / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    stream = st.read_stream(spark, str(flat), spark.read.parquet(str(flat)).schema, files_per_trigger=1)
    counts = st.windowed(st.with_event_time(stream, "ts", "15 minutes"), "ts", "30 minutes", [], [F.count("*").alias("n")], slide="15 minutes")
    out = str(tmp_path / "out")
    st.run_available(counts, st.table_sink(out), str(tmp_path / "ck"), "append")
    got = {r.start.strftime("%H:%M"): r.n for r in spark.read.parquet(out).select(F.date_format("start", "HH:mm").alias("s"), F.to_timestamp("start").alias("start"), "n").collect()}
    # 10:12 comes in time; when 10:01 comes, its windows are closed
    assert sum(got.values()) == 2 * 5
    assert spark.read.parquet(out).groupBy("start").count().where("count > 1").isEmpty()
