"""Footers, scans, compaction, sketches that merge, and ranks within large groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata import inspection
from strata.operators import quality, sketches, windows
from strata.sources import sinks


def test_compaction_keeps_null_keys(spark, tmp_path):
    at, to = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 5 != 0, F.lit("x")).alias("j"))
    df.repartition(5).write.partitionBy("k", "j").parquet(at)
    sinks.compact(spark, at, to, ["k", "j"], 1 << 30, ["id"])
    assert quality.same_rows(df, spark.read.parquet(to).select("id", "k", "j"))
    assert sinks.file_stats(spark, to).count() == 8


def test_row_groups_are_those_of_the_footers(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(5000).select("id", F.when(F.col("id") >= 4000, F.lit(None)).otherwise(F.col("id") % 97).alias("v"), F.struct((F.col("id") * 2).alias("b")).alias("s"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.timestamp_seconds("id").alias("i"))
    sinks.write_table(rows, at, n_files=2, sort_by=["v"], **{"parquet.block.row.count.limit": "300"})
    got = inspection.row_groups(spark, at, "v").collect()
    want = []
    for f in glob.glob(f"{at}/*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            c = meta.row_group(g).column(1)
            want.append((meta.row_group(g).num_rows, c.total_compressed_size, c.statistics.null_count, *((c.statistics.min, c.statistics.max) if c.statistics.has_min_max else (None, None))))
    assert sorted(((r.n_rows, r.column_bytes, r.nulls, r.low, r.high) for r in got), key=repr) == sorted(want, key=repr)
    groups = inspection.row_groups(spark, at, "v")
    for low, high in ((50, 60), (None, 3), (96, None), (200, None)):
        held = sum(r.n_rows for r in inspection.hit(groups, low, high).collect())
        true = rows.where((F.col("v") >= (low or 0)) & (F.col("v") <= (high if high is not None else 10**9))).count()
        assert true <= held < 5000
    assert inspection.row_groups(spark, at, "s.b").agg(F.max("high")).collect()[0][0] == 9998
    assert str(inspection.row_groups(spark, at, "t").agg(F.max("high")).collect()[0][0]) == "1970-01-01 01:23:19"
    assert inspection.row_groups(spark, at, "i").where("high IS NOT NULL").isEmpty()  # the usual form of an instant has no bounds


def test_scans_choose_files_and_leaves(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(100).select("id", F.struct(F.col("id").alias("a"), F.struct(F.col("id").alias("c"), F.lit("long text").alias("d")).alias("b")).alias("s"), (F.col("id") % 5).alias("k")).repartition("k").write.partitionBy("k").parquet(at)
    df = spark.read.parquet(at)
    assert [m["files"] for m in inspection.scan_metrics(df.where("k = 3").select("id"))] == [1]
    assert [(m["files"], m["rows"]) for m in inspection.scan_metrics(df.select("id"))] == [(5, 100)]
    assert inspection.plan_facts(df.select("s.b.c"))["read_schema"] == ["struct<s:struct<b:struct<c:bigint>>>"]
    assert "k#" in inspection.plan_facts(df.where("k = 3"))["partition_filters"][0]


def test_sketches_merge_like_sketches_of_all(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(4000)).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(0, 9, None), (1, 9, None)], "day long, k long, x long"))
    daily = sketches.sketched(rows, ["k", "day"], "x")
    merged = {r.k: r.n_distinct for r in sketches.estimated(sketches.merged(daily, ["k"])).collect()}
    whole = {r.k: r.n_distinct for r in sketches.estimated(sketches.sketched(rows, ["k"], "x")).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("x").alias("n")).collect()}
    assert merged.keys() == exact.keys() and merged[9] == 0
    for k, n in exact.items():
        assert abs(merged[k] - n) <= max(1, 4 * sketches.ERROR * n) and abs(merged[k] - whole[k]) <= max(1, 2 * sketches.ERROR * n)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_ranks_of_a_hot_group(spark, n):
    g = F.when(F.col("id") % 10 != 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 70).cast("string")))
    v = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)))  # most are equal
    df = spark.range(6000).select("id", g.alias("g"), v.alias("v"))
    got = windows.ranks_in_groups(df, ["g"], "v", ["id"], n)
    w = Window.partitionBy("g").orderBy(F.desc("v"))
    want = df.withColumns({"row_number": F.row_number().over(w.orderBy(F.desc("v"), "id")), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})
    cols = ["id", "g", "v", "row_number", "rank", "dense_rank"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)
    assert windows.ranks_in_groups(df.limit(0), ["g"], "v", ["id"]).isEmpty()
