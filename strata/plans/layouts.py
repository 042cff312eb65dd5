"""What a layout of files saves, proven from footers and scans; sketches that merge; ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import inspection
from strata.operators import changes, sketches, windows
from strata.plans.basics import _at
from strata.plans.revenue import read
from strata.session import cut
from strata.sources import sinks

#: Row groups of two files, in the query that counts which of them a bound can hit; and rows of a file at most, since its task sorts them.
GROUPS = 40
FILE_ROWS = 500_000
BOUND = 100_000.0


def k7_skipped_groups(spark, d):
    """Rows above a price by two layouts, and whether the row groups whose bounds can hold one have under a fifth of all rows."""
    (items,) = read(spark, d, "lineitem")
    n = items.count()
    n_files = max(2, -(-n // FILE_ROWS))
    rows, out = max(500, n // (GROUPS * n_files // 2)), []
    dealt = items.repartition(n_files, "l_orderkey", "l_linenumber")  # by key: rows dealt in turn are sorted before, a whole input task at a time
    for layout, sort in (("sorted", ["l_extendedprice"]), ("unsorted", None)):
        at = _at(spark, layout)
        sinks.write_table(dealt, at, sort_by=sort, **{"parquet.block.row.count.limit": str(rows)})
        groups = inspection.row_groups(spark, at, "l_extendedprice")
        total = groups.agg(F.sum("n_rows").alias("n_rows"))  # one row
        touched = inspection.hit(groups, low=BOUND).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("touched"))  # one row
        above = spark.read.parquet(at).where(F.col("l_extendedprice") > BOUND).agg(F.count("*").alias("n_above"))  # one row
        out.append(total.crossJoin(touched).crossJoin(above).select(F.lit(layout).alias("layout"), "n_rows", "n_above", (F.col("touched") < 0.2 * F.col("n_rows")).alias("skips"), (F.col("touched") >= F.col("n_above")).alias("holds_all")))
    return changes.union_all(out)


def k22_pruned_files(spark, d):
    """Files that a range of dates reads from folders by month: all of them by the date alone, those of two months with the bounds on the folder beside it."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "months")
    sinks.write_partitioned(orders.withColumn("m", sinks.partition_transform("o_orderdate", "months")), at, ["m"])
    low, high, df = "1995-02-10", "1995-03-20", spark.read.parquet(at)
    c = F.col("o_orderdate")
    ways = {"date": df.where((c >= F.lit(low).cast("timestamp_ntz")) & (c < F.lit(high).cast("timestamp_ntz"))), "folder": sinks.prune_filter(df, "o_orderdate", "m", "months", low, high)}
    rows = [(way, inspection.scan_metrics(found.select("o_orderkey"))[0]["files"], found.count()) for way, found in ways.items()]
    return spark.createDataFrame(rows, "way string, n_files long, n_rows long")


def k15_compacted(spark, d):
    """Small files of months, one of them null, compacted: as many rows a month, in one file."""
    (orders,) = read(spark, d, "orders")
    at, to = _at(spark, "small"), _at(spark, "compact")
    month = F.when(F.col("o_orderpriority") != "1-URGENT", F.date_format("o_orderdate", "yyyy"))
    orders.withColumn("month", month).repartition(6).write.partitionBy("month").parquet(at)
    sinks.compact(spark, at, to, ["month"], 1 << 30, ["o_orderkey"])
    rows = spark.read.parquet(to).select(F.col("month").cast("string").alias("month"), F.col("_metadata.file_path").alias("f"), "o_totalprice")
    return rows.groupBy("month").agg(F.count("*").alias("n_rows"), F.count_distinct("f").alias("n_files"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _seller_days(spark: SparkSession, d: str) -> DataFrame:
    items, orders = read(spark, d, "lineitem", "orders")
    o = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
    return items.select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def g2_customer_sketches(spark, d):
    """Distinct customers of each seller by day, month and in all: sketches by day, merged to the other levels, each against
    the exact number."""
    rows = _seller_days(spark, d).withColumns({"day": F.col("order_date").cast("string"), "month": F.date_format("order_date", "yyyy-MM"), "all": F.lit("all")})
    daily = cut(sketches.sketched(rows, ["l_suppkey", "day", "month", "all"], "o_custkey"), "sketches")
    out = []
    for level in ("day", "month", "all"):
        merged = daily if level == "day" else sketches.merged(daily, ["l_suppkey", level])
        exact = rows.groupBy("l_suppkey", level).agg(F.count_distinct("o_custkey").alias("n_customers"))
        both = sketches.estimated(merged).select("l_suppkey", level, "n_distinct").join(exact, ["l_suppkey", level])
        out.append(both.select(F.lit(level).alias("level"), "l_suppkey", F.col(level).alias("period"), "n_customers", sketches.within(F.col("n_distinct"), F.col("n_customers")).alias("within")))
    return changes.union_all(out)


def w1_ranks_in_groups(spark, d):
    """Ranks within a status, which may hold most of all orders, by price in steps of 10,000, so that many are equal."""
    (orders,) = read(spark, d, "orders")
    steps = orders.select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 10_000).alias("step"))
    return windows.ranks_in_groups(steps, ["o_orderstatus"], "step", ["o_orderkey"])


QUERIES = {f.__name__: f for f in (k7_skipped_groups, k15_compacted, k22_pruned_files, g2_customer_sketches, w1_ranks_in_groups)}
_EXACT = "SELECT l_suppkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m') AS month FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
ORACLE_SQL = {
    "k7_skipped_groups": f"SELECT layout, count(*) AS n_rows, count(*) FILTER (WHERE l_extendedprice > {BOUND}) AS n_above, layout = 'sorted' AS skips, true AS holds_all FROM lineitem, (VALUES ('sorted'), ('unsorted')) v(layout) GROUP BY layout",
    "k15_compacted": "SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate, '%Y') END AS month, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "k22_pruned_files": "SELECT 'date' AS way, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_files, count(*) FILTER (WHERE o_orderdate >= '1995-02-10' AND o_orderdate < '1995-03-20') AS n_rows FROM orders UNION ALL SELECT 'folder', count(DISTINCT strftime(o_orderdate, '%Y-%m')) FILTER (WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-02' AND '1995-03'), count(*) FILTER (WHERE o_orderdate >= '1995-02-10' AND o_orderdate < '1995-03-20') FROM orders",
    "g2_customer_sketches": f"WITH r AS ({_EXACT}) SELECT 'day' AS level, l_suppkey, day AS period, count(DISTINCT o_custkey) AS n_customers, true AS within FROM r GROUP BY l_suppkey, day UNION ALL SELECT 'month', l_suppkey, month, count(DISTINCT o_custkey), true FROM r GROUP BY l_suppkey, month UNION ALL SELECT 'all', l_suppkey, 'all', count(DISTINCT o_custkey), true FROM r GROUP BY l_suppkey",
    "w1_ranks_in_groups": "SELECT o_orderkey, o_orderstatus, step, row_number() OVER (PARTITION BY o_orderstatus ORDER BY step DESC, o_orderkey) AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice / 10000) AS BIGINT) AS step FROM orders) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY step DESC)",
}
