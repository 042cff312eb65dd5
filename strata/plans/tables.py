"""Joins, nested data, quality, changes and functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import columns
from strata.operators import changes, joins, nested, quality, windows
from strata.plans.revenue import read


def j2_customers_with_orders(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return joins.exists_in(customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), orders.select(F.col("o_custkey").alias("k")), ["k"])


def j3_customers_without_orders(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return joins.missing_from(customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


def j1_full_join(spark, d):
    customer, supplier = read(spark, d, "customer", "supplier")
    a = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer")


def j5_price_bands(spark, d):
    """Parts within price bands that overlap, cell by cell."""
    (part,) = read(spark, d, "part")
    low = F.floor(F.col("p_retailprice") / 50) * 50
    bands = part.select(low.alias("band")).distinct().select("band", F.col("band").alias("low"), (F.col("band") + 60).alias("high"))
    return joins.range_join(part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 60.0).groupBy("band").agg(F.count("*").alias("n"))


def _prices(orders):
    v = orders.select("o_custkey", F.to_date("o_orderdate").alias("valid_from"), "o_orderpriority").groupBy("o_custkey", "valid_from").agg(F.min("o_orderpriority").alias("priority"))
    from pyspark.sql import Window

    return v.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from")), F.lit("9999-12-31").cast("date"))).withColumnRenamed("o_custkey", "k")


def j6_point_in_time(spark, d):
    (orders,) = read(spark, d, "orders")
    fact = orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 10).alias("ts"))
    return joins.join_scd2(fact, _prices(orders), "k", "ts").select("o_orderkey", "priority")


def j12_null_safe(spark, d):
    customer, nation = read(spark, d, "customer", "nation")
    a = customer.select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    b = nation.select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k"), "n_name")
    return joins.join_null_safe(a, b, "k", "left").select("c_custkey", "n_name")


def j14_salted_join(spark, d):
    items, supplier = read(spark, d, "lineitem", "supplier")
    big = items.select(F.when(F.col("l_suppkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey")).alias("k"), "l_orderkey", "l_quantity")
    return joins.salted_join(big, supplier.select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k", 16).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def j15_hot_cold_join(spark, d):
    items, supplier = read(spark, d, "lineitem", "supplier")
    return joins.hot_cold_join(items.select(F.col("l_suppkey").alias("k"), "l_quantity"), supplier.select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k", [1, 2, 3]).groupBy("s_nationkey").agg(F.count("*").alias("n"))


def j17_referential_report(spark, d):
    items, orders, customer, part = read(spark, d, "lineitem", "orders", "customer", "part")
    return joins.referential_report([("items_orders", items, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey"), ("orders_customers", orders, "o_custkey", customer, "c_custkey"), ("items_parts", items, "l_partkey", part.where("p_size > 5"), "p_partkey")])


def n1_event_properties(spark, d):
    (events,) = read(spark, d, "events")
    good, bad = nested.parse_json(events, "props", T.StructType([T.StructField("k", T.LongType())]))
    rows = good.select("event_type", "parsed.k", F.lit(0).alias("bad")).unionByName(bad.select("event_type", F.lit(None).cast("long").alias("k"), F.lit(1).alias("bad")))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.sum("bad").alias("rejected"))


def n3_nested_orders(spark, d):
    items = read(spark, d, "lineitem")[0].select("l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    rows = nested.nest(items, ["l_orderkey"], ["price", "qty"])
    return rows.select("l_orderkey", F.size("items").alias("n"), F.round(nested.array_total(F.col("items")), 2).alias("total"), F.size(F.filter("items", lambda x: x["qty"] > 25)).alias("n_large"))


def n6_word_count(spark, d):
    return nested.word_count(read(spark, d, "documents")[0], "text")


def r5_price_tiers(spark, d):
    (part,) = read(spark, d, "part")
    return part.select("p_partkey", columns.tier(F.col("p_retailprice"), [(950, "middle"), (1000, "high")], "low").alias("tier"), F.round(columns.ratio(F.col("p_retailprice"), F.col("p_size") % 5), 4).alias("ratio"))


def r6_cast_losses(spark, d):
    (pages,) = read(spark, d, "pages")
    return columns.cast_losses(pages.select(F.regexp_extract("url", "/([^/?#]*)(?:[?#].*)?$", 1).alias("last"), F.col("page_id").cast("string").alias("id")), {"last": "int", "id": "int"})


def f1_strings(spark, d):
    (customer,) = read(spark, d, "customer")
    return customer.select("c_custkey", F.upper(F.trim("c_name")).alias("up"), F.lower("c_mktsegment").alias("low"), F.substring("c_name", 1, 4).alias("head"), F.regexp_replace("c_name", "[0-9]", "").alias("letters"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag"), F.element_at(F.split("c_name", "#"), -1).alias("tail"))


def f2_dates(spark, d):
    (orders,) = read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", F.year(day).alias("y"), F.quarter(day).alias("q"), F.weekofyear(day).alias("w"), F.dayofmonth(day).alias("d"), F.date_format(day, "yyyyMMdd").alias("key"), F.date_add(day, 30).alias("due"), F.to_date(F.date_trunc("month", day)).alias("month"))


def q3_null_profile(spark, d):
    (orders,) = read(spark, d, "orders")
    return quality.null_profile(orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")))


def q15_order_checks(spark, d):
    (orders,) = read(spark, d, "orders")
    rules = quality.not_null("o_custkey") | quality.accepted("o_orderstatus", ["F", "O"]) | quality.in_range("o_totalprice", 1000, 400000) | {"late": F.to_date("o_orderdate") > F.lit("1998-01-01").cast("date")}
    return quality.qc_report(orders, "orders", rules)


def q5_item_keys(spark, d):
    return quality.check_unique(read(spark, d, "lineitem")[0], "lineitem", ["l_orderkey", "l_linenumber"])


def q6_item_parts(spark, d):
    items, part = read(spark, d, "lineitem", "part")
    return quality.check_fk(items, "lineitem", "l_partkey", part.where("p_size < 40"), "p_partkey")


def q16_quarantine(spark, d):
    (orders,) = read(spark, d, "orders")
    _, bad = quality.split_quarantine(orders, {"status": F.col("o_orderstatus") == "P", "cheap": F.col("o_totalprice") < 5000})
    return bad.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


def _log(orders):
    """Changes of the customers' state: every order sets it, and every 7th one removes it."""
    return orders.select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, "d").otherwise("u").alias("op"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("ts_ms"), F.col("o_orderkey").alias("lsn"))


def m8_current_state(spark, d):
    return changes.current_state(_log(read(spark, d, "orders")[0]), ["k"])


def m4_apply_changes(spark, d):
    orders, customer = read(spark, d, "orders", "customer")
    target = customer.select(F.col("c_custkey").alias("k"), F.lit("-").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    return changes.apply_changes(target, _log(orders), ["k"])


def d5_history(spark, d):
    return changes.scd2_from_changes(_log(read(spark, d, "orders")[0]), ["k"], ["o_orderstatus"])


def d4_scd2(spark, d):
    (customer,) = read(spark, d, "customer")
    dim = customer.where("c_acctbal >= 0").select("c_custkey", "c_mktsegment", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(changes.OPEN_END).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    staged = customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return changes.scd2_apply(dim, staged, ["c_custkey"], ["c_mktsegment"], "2024-05-01")


def d8_dates(spark, d):
    low, high = read(spark, d, "orders")[0].agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).collect()[0]
    return changes.dim_date(spark, str(low), str(high))


def d10_star(spark, d):
    items, orders, part = read(spark, d, "lineitem", "orders", "part")
    out = joins.enrich(items, orders, ("l_orderkey", "o_orderkey"), [(part, "l_partkey", "p_partkey")], F.col("o_orderstatus") == "F")
    return out.groupBy("p_brand", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


def _sessions(events):
    """Events of a user no more than 30 minutes apart."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    marked = events.withColumn("_new", F.when(seconds.isNull() | (seconds > 1800), 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def g12_funnel(spark, d):
    s = _sessions(read(spark, d, "events")[0]).groupBy("user_id", "session").agg(F.min(F.to_date("ts")).alias("day"), *(F.max((F.col("event_type") == e).cast("int")).alias(e) for e in ("view", "click", "purchase")))
    return s.groupBy("day").agg(F.count("*").alias("sessions"), *(F.sum(e).cast("long").alias(e) for e in ("view", "click", "purchase")))


def g13_retention(spark, d):
    weeks = read(spark, d, "events")[0].select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).distinct()
    cohort = weeks.groupBy("user_id").agg(F.min("week").alias("cohort"))
    size = cohort.groupBy("cohort").agg(F.count("*").alias("size"))
    out = weeks.join(cohort, "user_id").groupBy("cohort", (F.datediff("week", "cohort") / 7).cast("int").alias("offset")).agg(F.count("*").alias("users"))
    return out.join(size, "cohort").select("cohort", "offset", "users", F.round(100 * F.col("users") / F.col("size"), 4).alias("percent"))


def t36_behaviour(spark, d):
    """Five events or more within ten minutes; a value over five times the mean of the user's earlier ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts"))
    events = read(spark, d, "events")[0]
    earlier = F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.select("event_id", (F.count("*").over(w.rangeBetween(-600, 0)) >= 5).alias("burst"), F.coalesce(F.col("value") > 5 * earlier, F.lit(False)).alias("large"))


def o3_top_orders(spark, d):
    return read(spark, d, "orders")[0].select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def o8_set_operations(spark, d):
    customer, supplier = read(spark, d, "customer", "supplier")
    a, b = customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("n")), supplier.select(F.col("s_nationkey").alias("n"))
    mark = lambda df, name: df.select("n", F.lit(name).alias("part"))
    return changes.union_all([mark(a.exceptAll(b), "minus"), mark(a.intersect(b), "both"), mark(a.union(b).distinct(), "either")])


def w1_ranks(spark, d):
    (part,) = read(spark, d, "part")
    return windows.rank_within(part.select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size", "p_partkey")


_S = "WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)"
_LOG = "SELECT o_custkey AS k, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'd' ELSE 'u' END AS op, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS ts_ms, o_orderkey AS lsn FROM orders"
_CHECK = "CASE WHEN f = 0 THEN 'pass' ELSE 'fail' END AS status, f AS failed_count, t AS total_count, round(100 * f / t, 4) AS failed_pct"
ORACLE_SQL = {
    "j1_full_join": "SELECT coalesce(a.nation, b.nation) AS nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.nation = b.nation",
    "j2_customers_with_orders": "SELECT c_custkey AS k, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "j3_customers_without_orders": "SELECT c_custkey AS k, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "j5_price_bands": "SELECT b.band, count(*) AS n FROM part a JOIN (SELECT DISTINCT CAST(floor(p_retailprice / 50) * 50 AS BIGINT) AS band FROM part) b ON a.p_retailprice >= b.band AND a.p_retailprice < b.band + 60 GROUP BY 1",
    "j6_point_in_time": "WITH v AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, min(o_orderpriority) AS priority FROM orders GROUP BY 1, 2), w AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY k ORDER BY a), DATE '9999-12-31') AS b FROM v) SELECT o_orderkey, priority FROM orders LEFT JOIN w ON o_custkey = k AND CAST(o_orderdate AS DATE) + 10 >= a AND CAST(o_orderdate AS DATE) + 10 < b",
    "j12_null_safe": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END IS NOT DISTINCT FROM CASE WHEN n_nationkey <> 3 THEN n_nationkey END",
    "j14_salted_join": "SELECT s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON s_suppkey = CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_suppkey END GROUP BY 1",
    "j15_hot_cold_join": "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "j17_referential_report": "SELECT *, round(100 * orphans / n_rows, 4) AS percent FROM (SELECT 'items_orders' AS relation, count(*) AS n_rows, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')) AS orphans FROM lineitem UNION ALL SELECT 'orders_customers', count(*), count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders UNION ALL SELECT 'items_parts', count(*), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) FROM lineitem)",
    "n1_event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE props IS NULL) AS rejected FROM events GROUP BY 1",
    "n3_nested_orders": "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * l_quantity), 2) AS total, count(*) FILTER (WHERE l_quantity > 25) AS n_large FROM lineitem GROUP BY 1",
    "n6_word_count": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1",
    "r5_price_tiers": "SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN 'high' WHEN p_retailprice >= 950 THEN 'middle' ELSE 'low' END AS tier, round(p_retailprice / nullif(p_size % 5, 0), 4) AS ratio FROM part",
    "r6_cast_losses": "SELECT 'last' AS \"column\", count(*) FILTER (WHERE try_cast(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS INTEGER) IS NULL) AS lost FROM pages UNION ALL SELECT 'id', 0",
    "f1_strings": "SELECT c_custkey, upper(trim(c_name)) AS up, lower(c_mktsegment) AS low, substr(c_name, 1, 4) AS head, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, c_mktsegment || '-' || c_nationkey AS tag, string_split(c_name, '#')[-1] AS tail FROM customer",
    "f2_dates": "SELECT o_orderkey, year(x) AS y, quarter(x) AS q, weekofyear(x) AS w, day(x) AS d, strftime(x, '%Y%m%d') AS key, x + 30 AS due, CAST(date_trunc('month', x) AS DATE) AS month FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)",
    "q3_null_profile": "SELECT * FROM (SELECT 'o_orderkey' AS \"column\", 0 AS nulls, 0.0 AS percent UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_orderkey % 7 = 0), round(100.0 * count(*) FILTER (WHERE o_orderkey % 7 = 0) / count(*), 4) FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus = 'P'), round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 4) FROM orders)",
    "q15_order_checks": f"SELECT 'orders' AS table_name, check_name, {_CHECK} FROM (SELECT 'o_custkey_not_null' AS check_name, count(*) FILTER (WHERE o_custkey IS NULL) AS f, count(*) AS t FROM orders UNION ALL SELECT 'o_orderstatus_accepted', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FROM orders UNION ALL SELECT 'o_totalprice_range', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000), count(*) FROM orders UNION ALL SELECT 'late', count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '1998-01-01'), count(*) FROM orders)",
    "q5_item_keys": f"SELECT 'lineitem' AS table_name, 'l_orderkey_l_linenumber_unique' AS check_name, {_CHECK} FROM (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS f, count(*) AS t FROM lineitem)",
    "q6_item_parts": f"SELECT 'lineitem' AS table_name, 'l_partkey_fk' AS check_name, {_CHECK} FROM (SELECT count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)) AS f, count(*) AS t FROM lineitem)",
    "q16_quarantine": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice < 5000 THEN 'cheap' END) AS reasons FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 5000",
    "m8_current_state": f"SELECT k, o_orderstatus, o_totalprice FROM (SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, lsn DESC) = 1) WHERE op <> 'd'",
    "m4_apply_changes": f"WITH l AS (SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, lsn DESC) = 1) SELECT c_custkey AS k, '-' AS o_orderstatus, c_acctbal AS o_totalprice FROM customer WHERE c_custkey NOT IN (SELECT k FROM l) UNION ALL SELECT k, o_orderstatus, o_totalprice FROM l WHERE op <> 'd'",
    "d5_history": f"WITH o AS (SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY k, ts_ms ORDER BY lsn DESC) = 1), n AS (SELECT *, lead(ts_ms) OVER (PARTITION BY k ORDER BY ts_ms) AS valid_to FROM o) SELECT k, o_orderstatus, ts_ms AS valid_from, valid_to, valid_to IS NULL AS is_current FROM n WHERE op <> 'd'",
    "d4_scd2": "SELECT c_custkey, c_mktsegment, DATE '2020-01-01' AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-05-01' ELSE DATE '9999-12-31' END AS valid_to, c_custkey % 3 <> 0 AS is_current FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END, DATE '2024-05-01', DATE '9999-12-31', true FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0",
    "d8_dates": "SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, x AS date, year(x) AS year, quarter(x) AS quarter, month(x) AS month, day(x) AS day, weekofyear(x) AS week, isodow(x) >= 6 AS is_weekend FROM (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS x)",
    "d10_star": "SELECT p_brand, year(o_orderdate) AS year, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY 1, 2",
    "g12_funnel": f"{_S}, p AS (SELECT min(CAST(ts AS DATE)) AS day, max(CAST(event_type = 'view' AS INTEGER)) AS v, max(CAST(event_type = 'click' AS INTEGER)) AS c, max(CAST(event_type = 'purchase' AS INTEGER)) AS p FROM s GROUP BY user_id, session) SELECT day, count(*) AS sessions, CAST(sum(v) AS BIGINT) AS view, CAST(sum(c) AS BIGINT) AS click, CAST(sum(p) AS BIGINT) AS purchase FROM p GROUP BY 1",
    "g13_retention": "WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events), c AS (SELECT user_id, min(week) AS cohort FROM w GROUP BY 1), z AS (SELECT cohort, count(*) AS size FROM c GROUP BY 1) SELECT cohort, CAST((week - cohort) / 7 AS INTEGER) AS \"offset\", count(*) AS users, round(100.0 * count(*) / any_value(size), 4) AS percent FROM w JOIN c USING (user_id) JOIN z USING (cohort) GROUP BY 1, 2",
    "t36_behaviour": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) >= 5 AS burst, coalesce(value > 5 * avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS large FROM events",
    "o3_top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "o8_set_operations": "SELECT n, 'minus' AS part FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal < 0 EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT n, 'both' FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT n, 'either' FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier)",
    "w1_ranks": "SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS row_number, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS dense_rank FROM part",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
