"""JDBC ranges, damage and what catches it, facts whose dimension comes late."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from strata import inspection
from strata.operators import damage, facts, quality
from strata.plans.sources import DRIVER, ORDER, PRIORITIES
from strata.sources import files, sinks


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(1000).select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 < 3, F.lit(7)).otherwise(F.col("id") * 1000).cast("long").alias("k"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")).alias("day"))
    rows.write.option("driver", DRIVER).jdbc(url, "t")
    return url, rows


@pytest.mark.parametrize("column", ['"k"', '"day"', '"id"'])
@pytest.mark.parametrize("bounds", [None, [], [5], [-10, 0, 10**9], [7, 7, 8]])
def test_each_row_once_whatever_the_bounds(spark, database, column, bounds):
    url, rows = database
    if column == '"day"':
        bounds = bounds and ["2024-01-05", "2030-01-01"]
    got = files.read_jdbc_ranges(spark, url, "t", column, 8, bounds, driver=DRIVER)
    assert quality.same_rows(rows, got.select(rows.columns))
    if bounds is None and column == '"id"':
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)


def test_ranges_and_queries_run_in_the_database(spark, database):
    url, _ = database
    assert files.range_predicates("c", [3, 9]) == ["c < 3 OR c IS NULL", "c >= 3 AND c < 9", "c >= 9"]
    got = files.read_jdbc_ranges(spark, url, "t", '"k"', 4, driver=DRIVER).where("id > 990 AND k IS NOT NULL").select("id")
    text = inspection.plan_text(got)
    assert "GreaterThan(id,990)" in text and "IsNotNull(k)" in text and inspection.plan_facts(got)["read_schema"] == ["struct<id:bigint>"]
    assert got.count() == 8
    few = files.read_jdbc(spark, url, query='SELECT COUNT(*) AS n FROM t WHERE "k" = 7', driver=DRIVER)
    assert few.collect()[0][0] == 400
    even = files.read_jdbc(spark, url, "t", column='"id"', low=100, high=200, n=4, driver=DRIVER)
    assert even.rdd.getNumPartitions() == 4 and even.count() == 1000


def test_damage_is_seeded_and_whole_lines_read_back(spark, tmp_path):
    orders = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit("2-HIGH").alias("o_orderpriority"), F.lit("2024-01-01").cast("date").alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"))
    lines = damage.damaged(orders, "o_orderkey", "o_orderpriority", ["o_orderdate"], 200, seed=3)
    again = damage.damaged(orders.repartition(7), "o_orderkey", "o_orderpriority", ["o_orderdate"], 200, seed=3)
    assert quality.same_rows(lines, again)
    other = damage.damaged(orders, "o_orderkey", "o_orderpriority", ["o_orderdate"], 200, seed=4)
    assert not quality.same_rows(lines, other)
    assert {r.kind for r in lines.select("kind").distinct().collect()} == {None, *damage.KINDS}
    assert 450 < lines.where("kind IS NOT NULL").count() < 750
    at = str(tmp_path / "l")
    lines.select("line").write.text(at)
    found = {r.kind: r for r in damage.caught(spark, at, lines, ORDER, {"o_orderpriority": PRIORITIES}).collect()}
    assert all(found[None][r] == 0 for r in damage.RULES)
    for kind in damage.KINDS:  # no kind slips through all checks
        assert max(found[kind][r] for r in damage.RULES) == found[kind].injected, kind
    assert found["shifted_columns"].text_corrupt == 0 < found["shifted_columns"].cast_loss
    none = damage.damaged(orders, "o_orderkey", "o_orderpriority", ["o_orderdate"], 0)
    assert none.where("kind IS NOT NULL").isEmpty()


DIM = "k int, name string, valid_from date, valid_to date"


def test_repair_rewrites_what_a_late_version_changes(spark, tmp_path):
    at = str(tmp_path / "f")
    rows = [(1, "a", "2020-01-01", "2022-01-01"), (1, "b", "2022-01-01", "9999-12-31"), (2, "x", "2020-01-01", "9999-12-31"), (None, "n", "2020-01-01", "9999-12-31")]
    as_dim = lambda r: facts.keyed(spark.createDataFrame(r, "k int, name string, valid_from string, valid_to string").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")}), "k")
    dim = as_dim(rows)
    fact = spark.createDataFrame([(n, k, f"20{y}-06-01") for n, (k, y) in enumerate([(1, 19), (1, 20), (1, 21), (1, 23), (2, 20), (2, 23), (3, 21), (None, 20)])], "n int, k int, at string").withColumn("at", F.col("at").cast("date")).withColumn("year", F.year("at"))
    sinks.write_partitioned(facts.resolve(fact, dim, "k", "at"), at, ["year"])
    names = lambda dim: {r.n: r.name for r in spark.read.parquet(at).join(facts.with_unknown(dim, "k").select("dim_key", "name"), "dim_key").collect()}
    assert names(dim) == {0: None, 1: "a", 2: "a", 3: "b", 4: "x", 5: "x", 6: None, 7: None}
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{at}/*/*.parquet")}
    # one of an unknown key, and one between two that were known
    late = as_dim([(3, "late", "2020-01-01", "9999-12-31"), (1, "between", "2021-01-01", "2022-01-01")])
    now = as_dim([(1, "a", "2020-01-01", "2021-01-01"), *rows[1:], (3, "late", "2020-01-01", "9999-12-31"), (1, "between", "2021-01-01", "2022-01-01")])
    changed = {r.year: r.n_changed for r in facts.repair(spark, at, now, late, "k", "at", ["year"]).collect()}
    assert changed == {2021: 2}
    assert names(now) == {0: None, 1: "a", 2: "between", 3: "b", 4: "x", 5: "x", 6: "late", 7: None}
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{at}/*/*.parquet")}
    assert {p.split("/")[-2] for p in before.items() ^ after.items() for p in [p[0]]} == {"year=2021"}
    assert facts.repair(spark, at, now, late, "k", "at", ["year"]).isEmpty() and len(names(now)) == 8


def test_upserts_of_null_keys_are_replayed_once(spark):
    from strata.operators import changes

    target = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    change = spark.createDataFrame([(None, "c"), (2, "d")], "k int, v string")
    once = changes.upsert(target, change, ["k"])
    assert sorted(map(tuple, changes.upsert(once, change, ["k"]).collect()), key=repr) == sorted([(1, "a"), (None, "c"), (2, "d")], key=repr)
    log = change.withColumns({"op": F.lit("d"), "ts_ms": F.lit(1), "lsn": F.lit(1)})
    assert [tuple(r) for r in changes.apply_changes(once, log, ["k"]).collect()] == [(1, "a")]
