"""Layered batch jobs: bronze as it came, silver cleaned, gold by day; each layer reads only the one before it.

Silver and gold lie in folders by month, the unit that a reload replaces: folders by day would be many small files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import quality, windows
from strata.plans.revenue import _NET, daily_revenue
from strata.session import shared_dir
from strata.sources import files, sinks

TABLES = ("orders", "lineitem")
COLUMNS = ["order_date", "n_orders", "revenue", "avg_ticket"]


def to_bronze(spark: SparkSession, sf_dir: str, root: str, run_id: str) -> None:
    """The sources with their lineage, nothing dropped."""
    for t in TABLES:
        sinks.write_table(files.with_lineage(spark.read.parquet(f"{sf_dir}/{t}.parquet"), run_id), f"{root}/bronze/{t}", mode="overwrite")


def to_silver(spark: SparkSession, root: str) -> None:
    """Orders with a known status, one row a key, by month; rows that break a rule go to quarantine with their reasons.
    Items by the month of their order, so that a month's gold needs that month's folders only."""
    orders = spark.read.parquet(f"{root}/bronze/orders")
    rules = {"key": F.col("o_orderkey").isNull(), "status": F.col("o_orderstatus").isNull() | ~F.col("o_orderstatus").isin("F", "O", "P"), "date": F.col("o_orderdate").isNull()}
    good, bad = quality.split_quarantine(orders, rules)
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    # few large months: files of a bounded number of rows
    sinks.write_partitioned(windows.latest_per_key(good, ["o_orderkey"], ["o_orderdate"], ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_orderdate", month), f"{root}/silver/orders", ["month"], max_records=5_000_000, overwrite="static")
    sinks.write_table(bad, f"{root}/silver/quarantine", mode="overwrite")
    clean = spark.read.parquet(f"{root}/silver/orders").select("o_orderkey", "month")
    items = spark.read.parquet(f"{root}/bronze/lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    sinks.write_partitioned(items.join(clean, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), f"{root}/silver/items", ["month"], max_records=5_000_000, overwrite="static")


def _daily(spark: SparkSession, root: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """The one transform of the full load, of a day and of a range: the months from low's to high's."""
    orders, items = spark.read.parquet(f"{root}/silver/orders"), spark.read.parquet(f"{root}/silver/items")
    if low is not None:
        within = F.col("month").cast("string").between(low[:7], high[:7])
        orders, items = orders.where(within), items.where(within)
    return daily_revenue(items.drop("month"), orders.drop("month")).select(*COLUMNS, F.date_format("order_date", "yyyy-MM").alias("month"))


def to_gold(spark: SparkSession, root: str) -> None:
    sinks.rebuild(_daily(spark, root), f"{root}/gold/daily_revenue", ["month"])


def run_medallion(spark: SparkSession, sf_dir: str, root: str, run_id: str = "full") -> None:
    to_bronze(spark, sf_dir, root, run_id)
    to_silver(spark, root)
    to_gold(spark, root)


def backfill(spark: SparkSession, root: str, low: str, high: str) -> None:
    """The months of the days low to high (yyyy-MM-dd) once more, in one job; each is replaced whole, so that a rerun
    changes nothing."""
    sinks.overwrite_partitions(_daily(spark, root, low, high), f"{root}/gold/daily_revenue", ["month"])


def load_day(spark: SparkSession, root: str, day: str) -> None:
    backfill(spark, root, day, day)


def gold(spark: SparkSession, root: str) -> DataFrame:
    return files.read_partitioned(spark, f"{root}/gold/daily_revenue", COLUMNS)


def b1_medallion(spark, d):
    root = f"{shared_dir(spark)}/strata-layers-{uuid.uuid4().hex}"
    run_medallion(spark, d, root)
    return gold(spark, root)


def b3_backfill(spark, d):
    """A year loaded again over the full load; the gold is the same."""
    root = f"{shared_dir(spark)}/strata-layers-{uuid.uuid4().hex}"
    run_medallion(spark, d, root)
    for _ in range(2):
        backfill(spark, root, "1995-01-01", "1995-12-31")
    return gold(spark, root)


QUERIES = {f.__name__: f for f in (b1_medallion, b3_backfill)}
_GOLD = f"SELECT CAST(o_orderdate AS DATE) AS order_date, count(DISTINCT o_orderkey) AS n_orders, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue, round(CAST(sum({_NET}) AS DOUBLE) / count(DISTINCT o_orderkey), 4) AS avg_ticket FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1"
ORACLE_SQL = {"b1_medallion": _GOLD, "b3_backfill": _GOLD}
