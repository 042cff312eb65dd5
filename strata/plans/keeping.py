"""Versions, sinks with a purpose, readers that put rows aside, records of a broker, and columns that are cleaned."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import columns
from strata.operators import aggregates, changes, damage, quality, windows
from strata.plans.basics import _at
from strata.plans.revenue import _NET, money, net, read
from strata.plans.sources import ORDER
from strata.plans.stream_audits import in_drops
from strata.plans.streams import _events, _run
from strata.sources import files, sinks, versions
from strata.streaming import events as st

STATUSES = ["F", "O", "P"]


def _versions(spark: SparkSession, d: str, label: str) -> tuple[str, DataFrame]:
    """The orders of one status, of two, and of all, each as a version."""
    (orders,) = read(spark, d, "orders")
    root = _at(spark, label)
    for k in (1, 2, 3):
        versions.publish(orders.where(F.col("o_orderstatus").isin(STATUSES[:k])), root, f"{k} statuses")
    return root, orders


def _summed(df: DataFrame, way: str) -> DataFrame:
    return df.agg(F.lit(way).alias("way"), F.count("*").alias("n_rows"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


def v2_versions(spark, d):
    """The latest version, one by number, the one at a time, and what a rollback gives."""
    root, _ = _versions(spark, d, "versions")
    second = versions.history(spark, root).where("version = 2").select("published_at").collect()[0][0]
    out = [_summed(versions.read_version(spark, root), "latest"), _summed(versions.read_version(spark, root, 1), "first"), _summed(versions.read_version(spark, root, as_of=second), "at a time")]
    versions.rollback(spark, root, 1)
    return changes.union_all([*out, _summed(versions.read_version(spark, root), "rolled back")])


def v3_version_history(spark, d):
    root, _ = _versions(spark, d, "history")
    return versions.history(spark, root).select("version", "note", "n_rows", "added_rows")


def v5_expired(spark, d):
    """Old versions go, the last two stay."""
    root, _ = _versions(spark, d, "expired")
    gone = versions.expire(spark, root, datetime.datetime(2999, 1, 1), retain_last=2)
    left = [_summed(versions.read_version(spark, root, v), f"version {v}") for v in (2, 3)]
    return changes.union_all(left).withColumn("n_deleted", F.lit(gone).cast("long"))


def v6_audited(spark, d):
    """A version whose audit fails is not published: readers see the one before."""
    root, orders = _versions(spark, d, "audited")
    of_price = lambda df: df.where("o_totalprice IS NULL OR o_totalprice < 0").count()
    versions.publish_if(orders.where("o_orderkey % 2 = 0"), root, of_price)
    try:
        versions.publish_if(orders.withColumn("o_totalprice", -F.col("o_totalprice")), root, of_price)
    except versions.AuditFailed:
        return _summed(versions.read_version(spark, root), "after the audit")
    return _summed(versions.read_version(spark, root), "published all the same")


def v7_version_delta(spark, d):
    """What each status earned in two versions of a mart."""
    root, _ = _versions(spark, d, "delta")
    marts = [versions.read_version(spark, root, v).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")) for v in (2, 3)]
    out = versions.version_delta(*marts, ["o_orderstatus"], ["n", "total"])
    return out.withColumn("delta_total", F.round("delta_total", 2))


def k12_dimension_file(spark, d):
    """A small dimension in one file, however many tasks it comes from."""
    (nation,) = read(spark, d, "nation")
    at = _at(spark, "dim")
    sinks.write_dim(nation.repartition(5), at)
    return sinks.file_stats(spark, at).agg(F.count("*").alias("n_files"), F.sum("rows").alias("n_rows"))


def k13_grain(spark, d):
    """The finest grain at which a partition has so many bytes, were the table of 100 bytes a row."""
    (orders,) = read(spark, d, "orders")
    total = 100 * orders.count()
    rows = [(target, sinks.choose_grain(orders, "o_orderdate", total, target)) for target in (1, 1_000, 10_000, 100_000, 10**12)]
    return spark.createDataFrame(rows, "target long, grain string")


def k14_quarantine(spark, d):
    """Rows put aside with all their reasons, by two runs; good ones go on."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "quarantine")
    rules = {"price": F.col("o_totalprice") > 150_000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    for k in (0, 1):
        good, bad = quality.split_quarantine(orders.where(F.col("o_orderkey") % 2 == k), rules)
        sinks.write_quarantine(bad.drop("reasons"), "rules", at) if k == 0 else sinks.write_quarantine(bad.withColumn("_r", F.array_join("reasons", "+")).drop("reasons"), F.col("_r"), at)
    return spark.read.parquet(at).groupBy("quarantine_reason").agg(F.count("*").alias("n"))


def k18_forced(spark, d):
    """A full read that keeps nothing, with what it saw counted on the way."""
    (orders,) = read(spark, d, "orders")
    from pyspark.sql import Observation

    seen = Observation()
    sinks.force(orders.observe(seen, F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    return spark.createDataFrame([(seen.get["n_rows"], seen.get["total"])], "n_rows long, total double")


def k20_daily_drops(spark, d):
    """History cut into drop folders of CSV, here a month each, and read back with the month from the folder."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "drops")
    sinks.split_by_day(orders.select("o_orderkey", "o_totalprice", "o_orderdate"), at, F.date_format("o_orderdate", "yyyy-MM"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.StringType()), T.StructField("dt", T.StringType())])
    return files.read_csv(spark, at, schema, "FAILFAST").groupBy("dt").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def s2_split(spark, d):
    """Damaged lines split into good rows and corrupt ones."""
    (orders,) = read(spark, d, "orders")
    rows = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    at = _at(spark, "split")
    damage.damaged(rows, "o_orderkey", "o_orderpriority", ["o_orderdate"], 50).select("line").write.text(at)
    good, bad, n = files.read_split(spark, at, ORDER, "run", header=False)
    traced = bad.agg(F.count(F.when(F.col("_source_file") != "", 1))).collect()[0][0]
    return good.agg(F.count("*").alias("good"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("good", "total", F.lit(n["corrupt"]).cast("long").alias("corrupt"), F.lit(traced).cast("long").alias("traced"))


def s5_bronze_text(spark, d):
    """All columns as text, from a list of their names; types come later, and tell what they can't hold."""
    (customer,) = read(spark, d, "customer")
    at = _at(spark, "bronze")
    sinks.write_table(customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 3, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")), at, "csv")
    bronze = files.read_csv(spark, at, files.raw_schema(["c_custkey", "c_acctbal"]))
    typed = columns.cast_all(bronze, {"c_custkey": "long", "c_acctbal": "double"})
    return typed.agg(F.count("*").alias("n_rows"), F.count("c_acctbal").alias("n_balances"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def r3_mapped(spark, d):
    (customer,) = read(spark, d, "customer")
    return columns.map_columns(customer.select("c_custkey", "c_name", "c_mktsegment"), F.lower, ["c_name", "c_mktsegment"])


def r10_changed(spark, d):
    """Rows that differ between two states; a null is equal to a null."""
    (orders,) = read(spark, d, "orders")
    old = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    new = F.when(F.col("o_orderkey") % 10 != 0, F.when(F.col("o_orderkey") % 7 == 0, F.lit("2-HIGH")).otherwise(F.col("o_orderpriority")))
    return orders.where(columns.changed(old, new)).select("o_orderkey", old.alias("old"), new.alias("new"))


def r13_clean(spark, d):
    """Status and dates as a source might give them, cleaned; days to delivery, none where it comes before the order."""
    items, orders = read(spark, d, "lineitem", "orders")
    raw = F.concat(F.lit("  "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("")))
    dated = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    rough = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.lit("   ")).otherwise(raw).alias("status"), dated.alias("ordered"))
    clean = rough.select("o_orderkey", columns.clean_status(F.col("status")).alias("status"), columns.parsed_date(F.col("ordered"), "yyyy-MM-dd", "dd/MM/yyyy").alias("ordered"))
    last = items.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("delivered"))
    return clean.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "status", columns.days_between(F.col("ordered"), F.col("delivered")).alias("days"))


def r15_replicated(spark, d):
    """Three times the orders, each copy a year later."""
    (orders,) = read(spark, d, "orders")
    more = aggregates.replicate(orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")), 3, "o_orderkey", "day", 365)
    return more.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


def g16_category_growth(spark, d):
    """Each brand's revenue by year: the best of the year, and the one that grew most since the year before."""
    items, orders, part = read(spark, d, "lineitem", "orders", "part")
    rows = items.join(orders.select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    years = windows.period_change(rows.groupBy("p_brand", "year").agg(money(net()).alias("revenue")), ["p_brand"], "year", "revenue")
    best = lambda by: F.max_by("p_brand", F.struct(F.col(by), F.col("p_brand")))
    return years.groupBy("year").agg(best("revenue").alias("top"), F.max("revenue").alias("top_revenue"), best("change_share").alias("grew"), F.round(F.max("change_share"), 6).alias("growth"))


def t3_decoded(spark, d):
    """Orders as records of a broker, some of them broken, in drops: what decodes, and dead letters with where they came from."""
    (orders,) = read(spark, d, "orders")
    root = _at(spark, "records")
    made = st.encode_records(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    number = F.col("key").cast("long")
    value = F.when(number % 10 == 0, F.lit(None)).when(number % 10 == 1, F.lit("{broken")).when(number % 10 == 2, F.regexp_replace("value", r'"o_totalprice":[0-9.E]+', '"o_totalprice":"dear"')).otherwise(F.col("value"))
    records = made.select(F.col("key").cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("orders").alias("topic"), (number % 3).cast("int").alias("partition"), number.alias("offset"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    good, dead = st.table_sink(f"{root}/good"), st.table_sink(f"{root}/dead")
    sink = st.fan_out(lambda b, n: good(b.where("NOT bad").select("key", "offset", "data.*"), n), lambda b, n: dead(b.where("bad").select("key", "topic", "partition", "offset", "value"), n))
    in_drops(records, F.col("partition"), 3, root, lambda s, k: st.run_available(st.decode_records(s, schema), sink, f"{root}/checkpoint"))
    a = spark.read.parquet(f"{root}/good").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    b = spark.read.parquet(f"{root}/dead").agg(F.lit("dead").alias("o_orderstatus"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return a.unionByName(b)


def t14_no_future(spark, d):
    """Events from the future, which would move the watermark past all others, don't get that far."""
    rows = _events(spark, d).withColumn("ts", F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.expr("INTERVAL 1000 YEARS")).otherwise(F.col("ts")))
    kept = st.dedup_stream(st.drop_future(rows, "ts", "1 HOUR"), ["event_id"], "ts", "1 hour")
    return _run(kept, "append").groupBy("event_type").agg(F.count("*").alias("n"))


def t17_tolerant_dedup(spark, d):
    """An event that comes again with another time is still one event."""
    again = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.col("copy")))
    return _run(st.dedup_stream(again, ["event_id"], "ts", "1 hour", within=True), "append").groupBy("event_type").agg(F.count("*").alias("n"))


def _clicks_and_purchases(spark: SparkSession, d: str, how: str) -> DataFrame:
    clicks = _events(spark, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = _events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    joined = st.interval_join(clicks, bought, "user_id", "click_ts", "purchase_ts", "1 hour", ("1 hour", "1 hour"), how)
    return _run(joined.select("click_id", *([] if how == "left_semi" else ["purchase_id"])), "append")


def t26_unmatched(spark, d):
    """Clicks with their purchases, and those that the watermark has passed without one."""
    return _clicks_and_purchases(spark, d, "left").select("click_id", "purchase_id")


def t27_matched(spark, d):
    """Clicks that a purchase follows, once each."""
    return _clicks_and_purchases(spark, d, "left_semi").select("click_id")


QUERIES = {f.__name__: f for f in (v2_versions, v3_version_history, v5_expired, v6_audited, v7_version_delta, k12_dimension_file, k13_grain, k14_quarantine, k18_forced, k20_daily_drops, s2_split, s5_bronze_text, r3_mapped, r10_changed, r13_clean, r15_replicated, g16_category_growth, t3_decoded, t14_no_future, t17_tolerant_dedup, t26_unmatched, t27_matched)}
_OF = "SELECT '{way}' AS way, count(*) AS n_rows, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders WHERE {where}"
_PAIRS = "SELECT a.event_id AS click_id, b.event_id AS purchase_id, a.ts AS click_ts FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click'"
ORACLE_SQL = {
    "v2_versions": " UNION ALL ".join(_OF.format(way=w, where=c) for w, c in (("latest", "o_orderstatus IN ('F', 'O', 'P')"), ("first", "o_orderstatus = 'F'"), ("at a time", "o_orderstatus IN ('F', 'O')"), ("rolled back", "o_orderstatus = 'F'"))),
    "v3_version_history": "WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b, count(*) FILTER (WHERE o_orderstatus = 'P') AS c FROM orders) SELECT CAST(1 AS BIGINT) AS version, '1 statuses' AS note, a AS n_rows, a AS added_rows FROM n UNION ALL SELECT 2, '2 statuses', a + b, b FROM n UNION ALL SELECT 3, '3 statuses', a + b + c, c FROM n",
    "v5_expired": "SELECT *, CAST(1 AS BIGINT) AS n_deleted FROM (" + " UNION ALL ".join(_OF.format(way=w, where=c) for w, c in (("version 2", "o_orderstatus IN ('F', 'O')"), ("version 3", "o_orderstatus IN ('F', 'O', 'P')"))) + ")",
    "v6_audited": _OF.format(way="after the audit", where="o_orderkey % 2 = 0"),
    "v7_version_delta": "WITH s AS (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1), b AS (SELECT *, o_orderstatus <> 'P' AS old FROM s) SELECT o_orderstatus, CASE WHEN old THEN n END AS old_n, n AS new_n, CASE WHEN old THEN 0 ELSE n END AS delta_n, CASE WHEN old THEN total END AS old_total, total AS new_total, CASE WHEN old THEN 0 ELSE total END AS delta_total FROM b",
    "k12_dimension_file": "SELECT CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows FROM nation",
    "k13_grain": "WITH n AS (SELECT 100 * count(*) AS b, count(DISTINCT CAST(o_orderdate AS DATE)) AS d, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS m, count(DISTINCT year(o_orderdate)) AS y FROM orders) SELECT CAST(target AS BIGINT) AS target, CASE WHEN b / d >= target THEN 'day' WHEN b / m >= target THEN 'month' WHEN b / y >= target THEN 'year' ELSE 'none' END AS grain FROM n, (VALUES (1), (1000), (10000), (100000), (1000000000000)) v(target)",
    "k14_quarantine": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'rules' ELSE concat_ws('+', CASE WHEN o_totalprice > 150000 THEN 'price' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) END AS quarantine_reason, count(*) AS n FROM orders WHERE o_totalprice > 150000 OR o_orderpriority = '1-URGENT' GROUP BY 1",
    "k18_forced": "SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders",
    "k20_daily_drops": "SELECT strftime(o_orderdate, '%Y-%m') AS dt, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "s2_split": f"WITH d AS (SELECT *, CAST('0x' || substr(md5('1:' || o_orderkey), 1, 8) AS BIGINT) AS x FROM orders), k AS (SELECT *, CASE WHEN x % 1000 < 50 THEN (x // 1000) % {len(damage.KINDS)} + 1 ELSE 0 END AS n FROM d) SELECT count(*) FILTER (WHERE n = 0) AS good, round(sum(o_totalprice) FILTER (WHERE n = 0), 2) AS total, count(*) FILTER (WHERE n > 0 AND n <> {damage.KINDS.index('blank_line') + 1}) AS corrupt, count(*) FILTER (WHERE n > 0 AND n <> {damage.KINDS.index('blank_line') + 1}) AS traced FROM k",
    "s5_bronze_text": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_custkey % 10 <> 3) AS n_balances, round(sum(c_acctbal) FILTER (WHERE c_custkey % 10 <> 3), 2) AS total FROM customer",
    "r3_mapped": "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer",
    "r10_changed": "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS old, CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN '2-HIGH' ELSE o_orderpriority END END AS new FROM orders) SELECT * FROM s WHERE old IS DISTINCT FROM new",
    "r13_clean": "WITH l AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS delivered FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN lower(o_orderstatus) END AS status, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_orderdate AS DATE) END AS ordered FROM orders) SELECT o_orderkey, status, CASE WHEN delivered >= ordered THEN date_diff('day', ordered, delivered) END AS days FROM o JOIN l ON o_orderkey = l_orderkey",
    "r15_replicated": "SELECT day, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT CAST(o_orderdate AS DATE) + CAST(365 * c AS INTEGER) AS day, o_orderkey || '-' || c AS k FROM orders, range(3) r(c)) GROUP BY 1",
    "g16_category_growth": f"WITH y AS (SELECT p_brand, year(o_orderdate) AS year, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), g AS (SELECT *, (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) AS s FROM y WINDOW w AS (PARTITION BY p_brand ORDER BY year)) SELECT year, arg_max(p_brand, (revenue, p_brand)) AS top, max(revenue) AS top_revenue, arg_max(p_brand, (coalesce(s, -1e300), p_brand)) AS grew, round(max(s), 6) AS growth FROM g GROUP BY year",
    "t3_decoded": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 10 > 2 GROUP BY 1 UNION ALL SELECT 'dead', count(*), NULL FROM orders WHERE o_orderkey % 10 <= 2",
    "t14_no_future": "SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "t17_tolerant_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "t26_unmatched": f"SELECT click_id, purchase_id FROM ({_PAIRS}) WHERE purchase_id IS NOT NULL OR epoch_us(click_ts) + 3600000000 < (SELECT least(max(epoch_us(ts)) FILTER (WHERE event_type = 'click'), max(epoch_us(ts)) FILTER (WHERE event_type = 'purchase')) // 1000 * 1000 - 3600000000 FROM events)",
    "t27_matched": f"SELECT DISTINCT click_id FROM ({_PAIRS}) WHERE purchase_id IS NOT NULL",
}
