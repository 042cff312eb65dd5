"""Reports and profiles that build on other marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import columns
from strata.operators import changes
from strata.plans import tables
from strata.plans.revenue import _NET, money, net, read


def sales_report(items: DataFrame, orders: DataFrame, sellers: DataFrame, parts: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revenue by seller, by month, nation and brand, and of the top brands.

    Items are joined with orders once and summed at once at the grain of all three reports, before the dimensions come
    in; what is left is small against the items, and reports that are read together share its shuffle."""
    o = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    by_part = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "l_partkey", "month").agg(F.sum(net()).alias("r"), F.count("*").alias("n"))
    wide = by_part.join(sellers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    base = wide.groupBy("s_suppkey", "s_nationkey", "month", "p_brand").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    sums = [money(F.col("r")).alias("revenue"), F.sum("n").alias("n_items")]
    best = base.groupBy("p_brand").agg(*sums).orderBy(F.desc("revenue"), "p_brand").limit(top)
    return base.groupBy("s_suppkey").agg(*sums), base.groupBy("month", "s_nationkey", "p_brand").agg(*sums), best


def g11_sales_report(spark, d):
    reports = zip(("seller", "month_nation_brand", "top_brand"), sales_report(*read(spark, d, "lineitem", "orders", "supplier", "part")), strict=True)
    keys = lambda df: F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns if c not in ("revenue", "n_items")))
    return changes.union_all([df.select(F.lit(name).alias("report"), keys(df).alias("key"), "revenue", "n_items") for name, df in reports])


def check_marts(funnel: DataFrame, retention: DataFrame) -> DataFrame:
    """Rows of each mart that break a rule of it: check_name, failed_count and total_count, one pass over each."""
    rules = {
        "funnel_narrows": (funnel, (F.col("purchase") > F.col("click")) | (F.col("click") > F.col("view"))),
        "funnel_within_sessions": (funnel, F.col("view") > F.col("sessions")),
        "retention_percent": (retention, ~F.col("percent").between(0, 100)),
        "retention_starts_whole": (retention, (F.col("offset") == 0) & (F.col("percent") != 100)),
    }
    out = []
    for df in (funnel, retention):
        own = {name: bad for name, (of, bad) in rules.items() if of is df}
        counts = df.agg(F.count("*").alias("total_count"), *(F.count(F.when(bad, 1)).alias(name) for name, bad in own.items()))
        pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(name).alias("failed_count")) for name in own))).alias("x")
        out.append(counts.select(pairs, "total_count").select("x.*", "total_count"))
    return changes.union_all(out)


def g14_mart_checks(spark, d):
    return check_marts(tables.g12_funnel(spark, d), tables.g13_retention(spark, d))


def build_profiles(txns: DataFrame, user: str, ts: str, place: str, amount: str, as_of: str, days: int = 30, tiers: tuple[float, float] = (45.0, 55.0)) -> DataFrame:
    """Of each user before as_of: the most frequent place (the first by name where several are), the mean amount of
    the last `days` days (in cents, null if there is none), and a tier by that mean. Null places don't count as a home."""
    end = F.lit(as_of).cast("timestamp_ntz")
    past = txns.where(F.col(ts).cast("timestamp_ntz") < end)
    recent = F.when(F.col(ts).cast("timestamp_ntz") >= end - F.expr(f"INTERVAL {int(days)} DAYS"), F.col(amount).cast("decimal(18,2)"))
    # a user's places are counted first, so that a busy user's rows don't meet in one task
    by_place = past.groupBy(user, place).agg(F.count("*").alias("_n"), F.sum(recent).alias("_sum"), F.count(recent).alias("_paid"))
    home = F.min_by(F.col(place), F.when(F.col(place).isNotNull(), F.struct(-F.col("_n"), F.col(place))))
    mean = F.sum("_sum").cast("double") / F.nullif(F.sum("_paid"), F.lit(0))
    out = by_place.groupBy(user).agg(home.alias("home"), F.round(mean, 6).alias("mean_amount"))
    return out.withColumn("risk_tier", columns.tier(F.col("mean_amount"), [(tiers[0], "middle"), (tiers[1], "high")], "low"))


def g17_profiles(spark, d):
    return build_profiles(read(spark, d, "events")[0], "user_id", "ts", "event_type", "value", "2024-01-25")


_WIDE = f"SELECT s_suppkey, s_nationkey, strftime(o_orderdate, '%Y-%m') AS month, p_brand, {_NET} AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
_SUMS = "CAST(round(sum(r), 2) AS DOUBLE) AS revenue, count(*) AS n_items FROM w"
QUERIES = {f.__name__: f for f in (g11_sales_report, g14_mart_checks, g17_profiles)}
ORACLE_SQL = {
    "g11_sales_report": f"WITH w AS ({_WIDE}) SELECT 'seller' AS report, CAST(s_suppkey AS VARCHAR) AS key, {_SUMS} GROUP BY 2 UNION ALL SELECT 'month_nation_brand', month || '|' || s_nationkey || '|' || p_brand, {_SUMS} GROUP BY 2 UNION ALL (SELECT 'top_brand', p_brand, {_SUMS} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)",
    "g14_mart_checks": f"WITH f AS ({tables.ORACLE_SQL['g12_funnel']}), r AS ({tables.ORACLE_SQL['g13_retention']}) SELECT 'funnel_narrows' AS check_name, count(*) FILTER (WHERE purchase > click OR click > view) AS failed_count, count(*) AS total_count FROM f UNION ALL SELECT 'funnel_within_sessions', count(*) FILTER (WHERE view > sessions), count(*) FROM f UNION ALL SELECT 'retention_percent', count(*) FILTER (WHERE percent NOT BETWEEN 0 AND 100), count(*) FROM r UNION ALL SELECT 'retention_starts_whole', count(*) FILTER (WHERE \"offset\" = 0 AND percent <> 100), count(*) FROM r",
    "g17_profiles": "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2), h AS (SELECT user_id, event_type AS home FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1), m AS (SELECT user_id, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 30 DAYS) AS DOUBLE) / count(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 30 DAYS), 6) AS mean_amount FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1) SELECT user_id, home, mean_amount, CASE WHEN mean_amount >= 55 THEN 'high' WHEN mean_amount >= 45 THEN 'middle' ELSE 'low' END AS risk_tier FROM h JOIN m USING (user_id)",
}
