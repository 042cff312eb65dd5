"""Functions in Python beside built-in ones that say the same, and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata import inspection
from strata.functions import columns, udfs
from strata.plans.revenue import read


def u1_masked(spark, d):
    """A mask by the built-in form, and whether the row-wise one says the same."""
    (customer,) = read(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 1, F.substring("c_name", 1, 5)).otherwise(F.col("c_name"))
    rows = customer.select("c_custkey", name.alias("name"))
    return rows.select("c_custkey", columns.mask_phone(F.col("name")).alias("masked"), columns.mask_phone(F.col("name")).eqNullSafe(udfs.mask_phone_py("name")).alias("agrees"))


def u4_scored(spark, d):
    """A model that each task loads once."""
    (items,) = read(spark, d, "lineitem")
    weights = {"l_quantity": 0.5, "l_discount": -3.0, "l_tax": 2.0}

    def load():
        return lambda f: f[["l_orderkey", "l_linenumber"]].assign(score=(sum(f[c] * w for c, w in weights.items()) + 1).round(6))

    scored = udfs.score_partitions(items.select("l_orderkey", "l_linenumber", *weights), load, "l_orderkey long, l_linenumber int, score double")
    return scored.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


def u5_zscores(spark, d):
    (part,) = read(spark, d, "part")
    rows = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("price"))
    return udfs.zscores(rows, "p_brand", "price").select("p_partkey", "p_brand", F.round("z", 6).alias("z"))


def u6_weighted_mean(spark, d):
    (items,) = read(spark, d, "lineitem")
    means = udfs.weighted_means(items, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return means.select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean_price"))


def u6_table_function(spark, d):
    """Words of the priorities, by a lateral join."""
    (orders,) = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 11 == 1, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    words = udfs.with_words(orders.select("o_orderkey", text.alias("text")), "text", keep_empty=True)
    return words.select("o_orderkey", "word", F.col("place").cast("long").alias("place"))


def x9_statistics(spark, d):
    """What ANALYZE says of the orders' columns; its distinct counts are estimates, and are held against a tenth."""
    table, cols = f"orders_{uuid.uuid4().hex}", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{d}/orders.parquet'")
    try:
        inspection.analyze(spark, table, cols)
        found = inspection.statistics(spark, table, cols)
        exact = read(spark, d, "orders")[0].agg(*(F.count_distinct(c).alias(c) for c in cols))  # one row
        each = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in cols))).alias("x")).select("x.*")
        out = found.join(each, "column").select("column", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n_nulls", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each column; the table goes
    finally:
        spark.sql(f"DROP TABLE {table}")


QUERIES = {f.__name__: f for f in (u1_masked, u4_scored, u5_zscores, u6_weighted_mean, u6_table_function, x9_statistics)}
_STATS = "SELECT '{c}' AS \"column\", {low} AS low, {high} AS high, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, true AS close FROM orders"
ORACLE_SQL = {
    "u1_masked": "WITH n AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN substr(c_name, 1, 5) ELSE c_name END AS name FROM customer) SELECT c_custkey, CASE WHEN length(name) >= 7 THEN substr(name, 1, 3) || '****' || substr(name, length(name) - 1, 2) WHEN name IS NOT NULL THEN '****' END AS masked, true AS agrees FROM n",
    "u4_scored": "SELECT l_orderkey, count(*) AS n, round(sum(round(0.5 * l_quantity - 3.0 * l_discount + 2.0 * l_tax + 1, 6)), 4) AS score FROM lineitem GROUP BY 1",
    "u5_zscores": "WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS price FROM part), s AS (SELECT *, avg(price) OVER w AS m, stddev_samp(price) OVER w AS sd FROM r WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, p_brand, round(CASE WHEN price IS NULL THEN NULL WHEN coalesce(sd, 0) = 0 THEN 0 ELSE (price - m) / sd END, 6) AS z FROM s",
    "u6_weighted_mean": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_price FROM lineitem GROUP BY 1, 2",
    "u6_table_function": "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS text FROM orders), w AS (SELECT o_orderkey, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS words FROM t) SELECT o_orderkey, unnest(words) AS word, CAST(unnest(range(len(words))) AS BIGINT) AS place FROM w WHERE len(words) > 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM w WHERE len(words) = 0",
    "x9_statistics": " UNION ALL ".join(_STATS.format(c=c, low=f"CAST(min({c}) AS DOUBLE)" if c != "o_orderstatus" else "CAST(NULL AS DOUBLE)", high=f"CAST(max({c}) AS DOUBLE)" if c != "o_orderstatus" else "CAST(NULL AS DOUBLE)") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")),
}
