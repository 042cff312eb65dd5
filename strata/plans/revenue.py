"""Revenue marts over orders and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import aggregates, joins, windows
from strata.session import cut, tasks_for


def net() -> Column:
    """What an item brings in, exactly."""
    return F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


def money(c: Column) -> Column:
    """An exact sum, rounded to cents."""
    return F.round(F.sum(c), 2).cast("double")


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def daily_revenue(items: DataFrame, orders: DataFrame, status: str = "F") -> DataFrame:
    """Orders, revenue and average ticket of each day, for orders of one status."""
    kept = orders.where(F.col("o_orderstatus") == status).select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    per_order = items.join(kept, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("order_date", "o_orderkey").agg(F.sum(net()).alias("r"))
    return per_order.groupBy("order_date").agg(F.count("*").alias("n_orders"), money(F.col("r")).alias("revenue"), F.round(F.sum("r").cast("double") / F.count("*"), 4).alias("avg_ticket"))


def g1_daily_revenue(spark, d):
    return daily_revenue(*read(spark, d, "lineitem", "orders"))


def seller_daily(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue, tax, items and orders of each seller and day: by order first, then by day, each dealt over tasks of a bounded number of rows."""
    n = tasks_for(items)
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    dealt = items.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax").repartition(n, "l_orderkey")
    per_order = dealt.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "order_date", "l_orderkey").agg(F.sum(net()).alias("r"), F.sum("l_tax").alias("t"), F.count("*").alias("n"))
    return per_order.repartition(n, "l_suppkey", "order_date").groupBy("l_suppkey", "order_date").agg(money(F.col("r")).alias("revenue"), F.round(F.sum("t"), 4).alias("tax"), F.sum("n").alias("n_items"), F.count("*").alias("n_orders"))


def g2_seller_daily(spark, d):
    return seller_daily(*read(spark, d, "lineitem", "orders"))


def g3_seller_moving_average(spark, d):
    sd = seller_daily(*read(spark, d, "lineitem", "orders")).select("l_suppkey", "order_date", "revenue")
    return windows.rolling_days(sd, ["l_suppkey"], "order_date", 7, F.avg("revenue"), "avg_7d").withColumn("avg_7d", F.round("avg_7d", 4))


def g4_monthly_revenue(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders"))


def g6_rfm(spark, d):
    """Recency, frequency and monetary value of each customer, in fifths; ranks need no single task."""
    (orders,) = read(spark, d, "orders")
    last = orders.agg(F.max(F.to_date("o_orderdate")).alias("today"))  # one row
    base = orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last_day"), F.count("*").alias("frequency"), F.round(F.sum("o_totalprice"), 2).alias("monetary"))
    base = base.crossJoin(F.broadcast(last)).select("o_custkey", F.datediff("today", "last_day").alias("recency"), "frequency", "monetary")
    base = cut(base.withColumn("nearness", -F.col("recency")), "rfm")
    n = base.agg(F.count("*").alias("_n"))  # one row
    for by in ("monetary", "frequency", "nearness"):
        base = windows.global_rank(base, by, "o_custkey", f"place_{by}")
    fifth = lambda by: (F.floor((F.col(f"place_{by}") - 1) * 5 / F.col("_n")) + 1).cast("int")
    return base.crossJoin(F.broadcast(n)).select("o_custkey", "recency", "frequency", "monetary", fifth("nearness").alias("recency_fifth"), fifth("frequency").alias("frequency_fifth"), fifth("monetary").alias("monetary_fifth"))


def g7_seller_rank(spark, d):
    items, supplier = read(spark, d, "lineitem", "supplier")
    sums = items.groupBy("l_suppkey").agg(money(net()).alias("revenue")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return windows.rank_within(sums.select("s_nationkey", "l_suppkey", "revenue"), "s_nationkey", "revenue", "l_suppkey")


def g8_lifetime_share(spark, d):
    (orders,) = read(spark, d, "orders")
    out = windows.running_total(orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "so_far")
    total = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return out.join(total, "o_custkey").select("o_custkey", "o_orderkey", F.round("so_far", 2).alias("so_far"), F.round(F.col("so_far") / F.col("total"), 6).alias("share"))


def g10_revenue_levels(spark, d):
    items, supplier, nation, region = read(spark, d, "lineitem", "supplier", "nation", "region")
    by_seller = items.groupBy("l_suppkey").agg(F.sum(net()).alias("r"))
    out = joins.enrich(by_seller, supplier, ("l_suppkey", "s_suppkey"), [(nation, "s_nationkey", "n_nationkey"), (region, "n_regionkey", "r_regionkey")])
    return aggregates.rollup_levels(out, ["r_name", "n_name"], money(F.col("r")).alias("revenue"))


def g16_weekly_trend(spark, d):
    (orders,) = read(spark, d, "orders")
    weeks = orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).withColumn("all", F.lit(1))
    return windows.period_change(weeks, ["all"], "week", "revenue").select("week", "revenue", "previous", F.round("change", 2).alias("change"))


def a10_priority_pivot(spark, d):
    (orders,) = read(spark, d, "orders")
    return aggregates.pivot_sum(orders.withColumn("year", F.year("o_orderdate")), ["year"], "o_orderstatus", ["F", "O", "P"], F.lit(1))


def a9_cube(spark, d):
    (items,) = read(spark, d, "lineitem")
    return items.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("long").alias("level"))


def a1_pricing_summary(spark, d):
    (items,) = read(spark, d, "lineitem")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_discount"), F.max("l_discount").alias("max_discount"), F.countDistinct("l_partkey").alias("n_parts"), F.count(F.when(F.col("l_quantity") > 25, 1)).alias("n_large"))


def a13_busy_customers(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


def a15_salted_sets(spark, d):
    (items,) = read(spark, d, "lineitem")
    return aggregates.salted_agg(items.select("l_returnflag", "l_suppkey"), ["l_returnflag"], 16, {"s": F.collect_set("l_suppkey")}, {"s": F.array_distinct(F.flatten(F.collect_list("s")))}).select("l_returnflag", F.size("s").alias("n_sellers"))


def a16_count_of_counts(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders")).groupBy("n_orders").agg(F.count("*").alias("n_customers"))


def w7_top_parts(spark, d):
    items, part = read(spark, d, "lineitem", "part")
    j = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return windows.top_n_share(j, "p_brand", "p_partkey", F.col("l_quantity"), 3).select("p_brand", "p_partkey", F.round("total", 2).alias("total"), "place", F.round("share", 6).alias("share"))


def w12_purchase_gaps(spark, d):
    (orders,) = read(spark, d, "orders")
    return windows.purchase_gaps(orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")), "o_custkey", "day", "o_orderkey")


def w4_latest_order(spark, d):
    (orders,) = read(spark, d, "orders")
    return windows.latest_per_key(orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def w15_global_rank(spark, d):
    (orders,) = read(spark, d, "orders")
    return windows.global_rank(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def w9_forward_fill(spark, d):
    (events,) = read(spark, d, "events")
    gaps = events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return windows.forward_fill(gaps, ["user_id"], ["ts", "event_id"], "last_purchase").select("event_id", "last_purchase")


def w10_rolling_rows(spark, d):
    (events,) = read(spark, d, "events")
    return windows.rolling_rows(events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], 5, F.avg("value"), "avg_5").select("event_id", F.round("avg_5", 6).alias("avg_5"))


def g15_price_outliers(spark, d):
    (part,) = read(spark, d, "part")
    return windows.zscore_outliers(part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", 1.6).select("p_partkey", F.round("z", 6).alias("z"))


def category_day(items: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Revenue of each brand and day, its change from the brand's last day with sales, the mean of 7 days, and the
    day's rank within the brand."""
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    j = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    days = j.groupBy("p_brand", "order_date").agg(money(net()).alias("revenue"))
    out = windows.rolling_days(windows.period_change(days, ["p_brand"], "order_date", "revenue"), ["p_brand"], "order_date", 7, F.avg("revenue"), "avg_7d")
    place = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("revenue")))
    return out.select("p_brand", "order_date", "revenue", F.round("change", 2).alias("change"), F.round("avg_7d", 4).alias("avg_7d"), place.alias("place"))


def g9_category_day(spark, d):
    return category_day(*read(spark, d, "lineitem", "orders", "part"))


def seller_service(items: DataFrame, orders: DataFrame, days: int = 60) -> DataFrame:
    """Of each seller and day of order: the share of items that were shipped more than `days` later, and their mean
    discount, in place of a score."""
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    late = F.when(F.datediff("l_shipdate", "order_date") > days, 1).otherwise(0)
    return items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "order_date").agg(F.count("*").alias("n_items"), F.round(F.avg(late), 6).alias("late_rate"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


def g5_seller_service(spark, d):
    return seller_service(*read(spark, d, "lineitem", "orders"))


_NET = "CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
QUERIES = {f.__name__: f for f in (g1_daily_revenue, g2_seller_daily, g3_seller_moving_average, g4_monthly_revenue, g5_seller_service, g6_rfm, g7_seller_rank, g8_lifetime_share, g9_category_day, g10_revenue_levels, g15_price_outliers, g16_weekly_trend, a1_pricing_summary, a9_cube, a10_priority_pivot, a13_busy_customers, a15_salted_sets, a16_count_of_counts, w4_latest_order, w7_top_parts, w9_forward_fill, w10_rolling_rows, w12_purchase_gaps, w15_global_rank)}
ORACLE_SQL = {
    "g1_daily_revenue": f"SELECT CAST(o_orderdate AS DATE) AS order_date, count(DISTINCT o_orderkey) AS n_orders, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue, round(CAST(sum({_NET}) AS DOUBLE) / count(DISTINCT o_orderkey), 4) AS avg_ticket FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "g2_seller_daily": f"SELECT l_suppkey, CAST(o_orderdate AS DATE) AS order_date, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue, round(sum(l_tax), 4) AS tax, count(*) AS n_items, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "g3_seller_moving_average": f"WITH d AS (SELECT l_suppkey, CAST(o_orderdate AS DATE) AS order_date, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT *, round(avg(revenue) OVER (PARTITION BY l_suppkey ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS avg_7d FROM d",
    "g4_monthly_revenue": "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "g6_rfm": "WITH b AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS l, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1) SELECT o_custkey, date_diff('day', l, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS recency, frequency, monetary, " + ", ".join(f"CAST(floor((row_number() OVER (ORDER BY {c} DESC, o_custkey) - 1) * 5 / count(*) OVER ()) + 1 AS INTEGER) AS {n}_fifth" for c, n in (("l", "recency"), ("frequency", "frequency"), ("monetary", "monetary"))) + " FROM b",
    "g7_seller_rank": f"WITH r AS (SELECT l_suppkey, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1) SELECT s_nationkey, l_suppkey, revenue, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, l_suppkey) AS row_number, rank() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC) AS rank, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC) AS dense_rank FROM r JOIN supplier ON l_suppkey = s_suppkey",
    "g8_lifetime_share": "WITH s AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS t FROM orders) SELECT o_custkey, o_orderkey, round(s, 2) AS so_far, round(s / t, 6) AS share FROM s",
    "g5_seller_service": "SELECT l_suppkey, CAST(o_orderdate AS DATE) AS order_date, count(*) AS n_items, round(avg(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60 THEN 1 ELSE 0 END), 6) AS late_rate, round(avg(l_discount), 6) AS mean_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "g9_category_day": f"WITH d AS (SELECT p_brand, CAST(o_orderdate AS DATE) AS order_date, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, order_date, revenue, round(revenue - lag(revenue) OVER (PARTITION BY p_brand ORDER BY order_date), 2) AS change, round(avg(revenue) OVER (PARTITION BY p_brand ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS avg_7d, rank() OVER (PARTITION BY p_brand ORDER BY revenue DESC) AS place FROM d",
    "g10_revenue_levels": f"SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS level, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "g15_price_outliers": "WITH s AS (SELECT p_partkey, (p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_samp(p_retailprice) OVER w, 0) AS z FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, round(z, 6) AS z FROM s WHERE abs(z) > 1.6",
    "g16_weekly_trend": "WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1) SELECT week, revenue, lag(revenue) OVER (ORDER BY week) AS previous, round(revenue - lag(revenue) OVER (ORDER BY week), 2) AS change FROM w",
    "a1_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_discount, max(l_discount) AS max_discount, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_quantity > 25) AS n_large FROM lineitem GROUP BY 1, 2",
    "a9_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "a10_priority_pivot": "SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "a13_busy_customers": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "a15_salted_sets": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_sellers FROM lineitem GROUP BY 1",
    "a16_count_of_counts": "SELECT n AS n_orders, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1",
    "w4_latest_order": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "w7_top_parts": "WITH s AS (SELECT p_brand, p_partkey, sum(l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, p_partkey, round(t, 2) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY t DESC, p_partkey) AS place, round(t / sum(t) OVER (PARTITION BY p_brand), 6) AS share FROM s QUALIFY place <= 3",
    "w9_forward_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
    "w10_rolling_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS avg_5 FROM events",
    "w12_purchase_gaps": "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER w AS nth, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) AS gap_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)",
    "w15_global_rank": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
}
