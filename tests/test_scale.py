"""What one task holds stays the same however large a table is."""

import glob

from compare import same
from pyspark.sql import functions as F

from strata import inspection
from strata.functions import udfs
from strata.plans import basics, layouts, python, revenue
from strata.session import tasks_for
from strata.streaming import events as st
from strata.streaming import jobs

DATA = "/root/testdata/sf0.001"


def written(monkeypatch, module, tmp_path):
    """Folders that a module's queries write to, by label."""
    monkeypatch.setattr(module, "_at", lambda spark, label: str(tmp_path / label))


def test_row_groups_of_many_files(spark, tmp_path, monkeypatch):
    written(monkeypatch, layouts, tmp_path)
    monkeypatch.setattr(layouts, "FILE_ROWS", 1500, raising=False)
    got = {r.layout: r for r in layouts.k7_skipped_groups(spark, DATA).collect()}
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert [len(glob.glob(f"{tmp_path}/{k}/*.parquet")) for k in ("sorted", "unsorted")] == [-(-n // 1500)] * 2
    assert all(r.n_rows == n and r.holds_all for r in got.values())


def test_sellers_days_are_dealt_by_rows(spark, monkeypatch):
    assert [tasks_for(spark.range(n), 3, 2) for n in (0, 6, 7, 10)] == [2, 2, 3, 4] and tasks_for(spark.range(1)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(revenue, "tasks_for", lambda df: 7)
    days = revenue.seller_daily(*revenue.read(spark, DATA, "lineitem", "orders"))
    assert days.rdd.getNumPartitions() == 7
    same(spark, revenue.g2_seller_daily, revenue.ORACLE_SQL["g2_seller_daily"], DATA)


def test_capped_files_come_from_tasks_by_rows(spark, tmp_path, monkeypatch):
    written(monkeypatch, basics, tmp_path)
    monkeypatch.setattr(basics, "tasks_for", lambda df, least: 5, raising=False)
    same(spark, basics.k8_rows_a_file, basics.ORACLE_SQL["k8_rows_a_file"], DATA)
    assert len({f.split("part-")[1][:5] for f in glob.glob(f"{tmp_path}/capped/*.parquet")}) == 5


def test_weighted_means_of_batches(spark):
    nan = float("nan")
    rows = [("a", 1, 2.0, 1.0), ("a", 1, 4.0, 3.0), ("a", 1, None, 4.0), ("a", 1, nan, 8.0), ("a", 2, 5.0, None), (None, 1, 7.0, 2.0), (None, None, 8.0, 2.0), ("b", 1, 1.0, 1.0), ("b", 1, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "k string, j long, x double, w double").repartition(5)
    got = {(r.k, r.j): r.mean for r in udfs.weighted_means(df, ["k", "j"], "x", "w").collect()}
    assert got == {("a", 1): 14 / 16, ("a", 2): None, (None, 1): 7.0, (None, None): 8.0, ("b", 1): None}
    whole = df.groupBy("k", "j").agg(udfs.weighted_mean("x", "w").alias("mean")).collect()
    assert got == {(r.k, r.j): r.mean for r in whole}
    assert udfs.weighted_means(df.limit(0), ["k"], "x", "w").isEmpty()
    facts = inspection.plan_facts(python.u6_weighted_mean(spark, DATA))
    assert facts["python"] == ["MapInArrow"]  # no group is gathered for Python


def test_long_keys_are_made_after_the_joins(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = inspection.plan_text(basics.d9_fact(spark, DATA))
        # the last stage's projection alone makes keys: no row with one is shuffled
        assert not [line for line in text.split("\n\n") if ") Exchange" in line and "_key#" in line]
        same(spark, basics.d9_fact, basics.ORACLE_SQL["d9_fact"], DATA)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_times_of_sessions_reach_python_as_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1_700_000_000, "view", "not needed")], "user long, at long, kind string, other string").withColumn("ts", F.timestamp_seconds("at"))
    rows.write.parquet(f"{tmp_path}/s")
    stream = st.with_event_time(st.read_stream(spark, f"{tmp_path}/s", rows.schema), "ts", "1 minute")
    plan = jobs.session_paths(stream, "user", "ts", "kind", "kind", ["view"], 1800)._jdf.queryExecution().analyzed().toString()
    assert "other" not in plan.split("FlatMapGroupsInPandasWithState")[1].split("\n")[1]  # columns that no session needs stay out
    assert "timestamp_micros(session_start" in plan
