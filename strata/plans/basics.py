"""Readers, writers, SQL text, columns, joins, aggregates, windows, checks and dimensions over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import columns
from strata.operators import aggregates, changes, joins, nested, quality
from strata.plans.revenue import _NET, money, net, read
from strata.session import cut, shared_dir, tasks_for
from strata.sources import files, sinks


def _at(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strata-{label}-{uuid.uuid4().hex}"


# readers and writers: each table is written in another form and read again


def s1_csv(spark, d):
    """CSV parts with a header each, read by a frozen schema in the mode that fails on any bad line."""
    (customer,) = read(spark, d, "customer")
    at = _at(spark, "csv")
    sinks.write_table(customer, at, "csv", codec="gzip")
    return files.read_csv(spark, at, customer.schema, "FAILFAST")


def s3_dropped_rows(spark, d):
    """Rows that a stricter schema drops: keys of customers whose balance is no whole number are gone."""
    (customer,) = read(spark, d, "customer")
    at = _at(spark, "csv")
    sinks.write_table(customer.select("c_custkey", F.floor("c_acctbal").cast("string").alias("a")).withColumn("a", F.when(F.col("a").startswith("-"), "bad").otherwise(F.col("a"))), at, "csv")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("a", T.LongType())])
    return files.read_csv(spark, at, schema, "DROPMALFORMED").select("c_custkey", "a")


def s7_json(spark, d):
    (nation,) = read(spark, d, "nation")
    at = _at(spark, "json")
    sinks.write_table(nation, at, "json")
    return files.read_json(spark, at, nation.schema)


def s9_orc(spark, d):
    (supplier,) = read(spark, d, "supplier")
    at = _at(spark, "orc")
    sinks.write_table(supplier, at, "orc", codec="zlib")
    return files.read_orc(spark, at)


def s10_raw_lines(spark, d):
    """Lines of the text against the rows that were written."""
    (part,) = read(spark, d, "part")
    at = _at(spark, "lines")
    sinks.write_table(part, at, "csv", coalesce=1)
    return spark.read.text(at).agg((F.count("*") - 1).alias("n_lines"))


def s11_merged_schema(spark, d):
    (region,) = read(spark, d, "region")
    at = _at(spark, "evolved")
    sinks.write_table(region, f"{at}/a")
    sinks.write_table(region.withColumn("note", F.upper("r_name")), f"{at}/b")
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(at).select("r_regionkey", "r_name", "note")


def k2_save_modes(spark, d):
    """overwrite, append, then a write that is ignored, since the table is there."""
    (nation,) = read(spark, d, "nation")
    at = _at(spark, "modes")
    for mode in ("overwrite", "append", "ignore"):
        sinks.write_table(nation, at, mode=mode)
    return spark.read.parquet(at).groupBy("n_nationkey").agg(F.count("*").alias("copies"))


def k8_rows_a_file(spark, d):
    """No file has more rows than the cap; all rows are there. Each task sorts a bounded number of rows."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "capped")
    sinks.write_table(orders.repartition(tasks_for(orders, least=2), "o_orderkey"), at, max_records=1_000, codec="zstd", sort_by=["o_orderkey"])
    return sinks.file_stats(spark, at).agg(F.sum("rows").alias("n_rows"), F.count(F.when(F.col("rows") > 1_000, 1)).alias("too_large"))


def k10_ranged_files(spark, d):
    """Files ordered among themselves: the key ranges of no two overlap."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "ranged")
    sinks.write_table(orders, at, range_by=["o_orderkey"], n_files=6)
    each = spark.read.parquet(at).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))
    # a row for each file
    marked = each.withColumn("overlaps", F.coalesce(F.lag("high").over(Window.orderBy("low")) >= F.col("low"), F.lit(False)))
    return marked.agg(F.sum("n").alias("n_rows"), F.count(F.when(F.col("overlaps"), 1)).alias("overlaps"))


def k17_small_files(spark, d):
    """Files that each way of writing days by month leaves, and that all ways keep all rows: one file a month by key, three by
    a second hash, few for all without a key."""
    (orders,) = read(spark, d, "orders")
    orders = orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    out = []
    for name in ("key", "dealt", "one"):
        at = _at(spark, name)
        if name == "one":
            sinks.write_table(orders, at, coalesce=1)
        else:
            sinks.write_partitioned(orders, at, ["month"], files_per_key=1 if name == "key" else 3, by="o_orderkey")
        stats = spark.read.parquet(at).select(F.col("_metadata.file_path").alias("f"), "month").groupBy("month").agg(F.count_distinct("f").alias("files"), F.count("*").alias("n"))
        out.append(stats.agg(F.lit(name).alias("way"), F.sum("n").alias("n_rows"), (F.max("files") <= (3 if name == "dealt" else 1)).alias("as_planned")))
    return changes.union_all(out)


def k21_transformed_key(spark, d):
    """A month's rows by a predicate on the date, which is rewritten to the partition column."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "months")
    sinks.write_partitioned(orders.withColumn("m", sinks.partition_transform("o_orderdate", "months")), at, ["m"])
    return sinks.prune_filter(spark.read.parquet(at), "o_orderdate", "m", "months", "1995-02-10", "1995-03-20").select("o_orderkey", "o_totalprice")


def n5_nested_files(spark, d):
    """Nested rows written and read; only the leaf that is asked for is scanned."""
    (items,) = read(spark, d, "lineitem")
    at = _at(spark, "nested")
    rows = items.groupBy("l_orderkey").agg(F.struct(F.count("*").alias("n"), F.struct(F.max("l_quantity").alias("most")).alias("q")).alias("s"))
    sinks.write_table(rows, at)
    return spark.read.parquet(at).select("l_orderkey", F.col("s.q.most").alias("most"))


# SQL text


def s16_temp_view(spark, d):
    orders, customer = read(spark, d, "orders", "customer")
    orders.createOrReplaceTempView("strata_orders")
    customer.createOrReplaceTempView("strata_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM strata_orders JOIN strata_customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


def o7_union_all(spark, d):
    read(spark, d, "customer")[0].createOrReplaceTempView("strata_customer")
    read(spark, d, "supplier")[0].createOrReplaceTempView("strata_supplier")
    return spark.sql("SELECT c_nationkey AS nation, c_acctbal AS balance FROM strata_customer UNION ALL SELECT s_nationkey, s_acctbal FROM strata_supplier")


def j10_sql_hints(spark, d):
    """A hint for the table of nations, of 25 rows, and one for the number of partitions."""
    for t in ("customer", "nation"):
        read(spark, d, t)[0].createOrReplaceTempView(f"strata_{t}")
    return spark.sql("SELECT /*+ BROADCAST(n), REPARTITION(4) */ n_name, count(*) AS customers FROM strata_customer c JOIN strata_nation n ON c_nationkey = n_nationkey GROUP BY n_name")


# columns


def r2_expressions(spark, d):
    return read(spark, d, "part")[0].selectExpr("p_partkey", "upper(p_brand) AS brand", "p_size * 2 AS doubled", "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind")


def r8_filters(spark, d):
    (part,) = read(spark, d, "part")
    kept = F.col("p_brand").startswith("Brand#1") | F.col("p_name").contains("a") & F.col("p_type").rlike("^[A-M]") & F.col("p_size").between(5, 40)
    return part.where(kept & ~F.col("p_size").isin(7, 11)).select("p_partkey", "p_size")


def r9_complement(spark, d):
    """All that isn't a purchase, unknown types too; with types that are null."""
    events = read(spark, d, "events")[0].select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return events.where(columns.not_equal_or_null(F.col("kind"), "purchase")).select("event_id", "kind")


def r16_random_split(spark, d):
    """Two parts by chance: each row is in one of them, and the first has about its share."""
    (items,) = read(spark, d, "lineitem")
    a, b = items.randomSplit([0.8, 0.2], seed=5)
    n = a.select(F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))).agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    return n.select((F.col("a") + F.col("b")).alias("n_rows"), (F.col("a") / (F.col("a") + F.col("b"))).between(0.75, 0.85).alias("about_right"))


def f2_dates(spark, d):
    o = F.col("o_orderdate")
    return read(spark, d, "orders")[0].select("o_orderkey", F.dayofweek(o).alias("weekday"), F.last_day(o.cast("date")).alias("month_end"), F.add_months(o.cast("date"), 1).alias("later"), F.datediff(F.lit("2000-01-01").cast("date"), o.cast("date")).alias("age"), F.quarter(o).alias("quarter"), F.date_format(o, "yyyyMMdd").alias("key"))


def f3_math(spark, d):
    c = F.col("c_acctbal")
    return read(spark, d, "customer")[0].select("c_custkey", F.abs(c).alias("size"), F.pmod(F.floor(c).cast("long"), F.lit(7)).alias("rest"), F.round(F.log1p(F.abs(c)), 6).alias("log"), F.round(F.sqrt(F.abs(c)), 6).alias("root"), F.signum(c).cast("int").alias("sign"), F.greatest(c, F.lit(0.0)).alias("least_zero"))


def f4_hashes(spark, d):
    return read(spark, d, "supplier")[0].select("s_suppkey", F.md5(F.col("s_name").cast("binary")).alias("md5"), F.sha2(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")), 256).alias("sha"))


def f6_arrays(spark, d):
    """Words of a part's type with their positions, beside the length of each."""
    part = read(spark, d, "part")[0].withColumn("w", F.split("p_type", " "))
    zipped = part.select("p_partkey", F.posexplode(F.arrays_zip("w", F.transform("w", lambda x: F.length(x)).alias("n"))).alias("pos", "x"))
    return zipped.select("p_partkey", "pos", F.col("x.w").alias("word"), F.col("x.n").alias("n"))


def f7_maps(spark, d):
    """Orders of each status as a map, read by key, with what has no entry."""
    n = read(spark, d, "orders")[0].groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select("o_custkey", F.coalesce(F.col("m")["F"], F.lit(0)).alias("done"), F.size(F.map_keys("m")).alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def n2_keep_empty(spark, d):
    """Items of each customer's order of the highest price, customers without orders too."""
    orders, customer = read(spark, d, "orders", "customer")
    own = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("orders"))
    rows = customer.select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "orders")
    return nested.flatten_items(rows, "orders")


def n4_flat_structs(spark, d):
    n = read(spark, d, "nation")[0].select("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("region")).alias("at"))
    return nested.flatten_struct(n)


# joins and aggregates


def j7_strategies(spark, d):
    """The same join by each strategy; nations are 25 rows."""
    customer, nation = read(spark, d, "customer", "nation")
    n, out = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), []
    for strategy in ("broadcast", "merge", "shuffle_hash"):
        out.append(joins.join(customer, n, "c_nationkey", strategy=strategy).groupBy("n_name").agg(F.lit(strategy).alias("strategy"), F.count("*").alias("n")))
    return changes.union_all(out)


def j13_duplicate_keys(spark, d):
    return joins.duplicate_keys(read(spark, d, "lineitem")[0], ["l_orderkey", "l_linenumber"])


def j16_inherited_date(spark, d):
    items, orders = read(spark, d, "lineitem", "orders")
    found, orphans = joins.inherit_column(items.select("l_orderkey", "l_quantity"), orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day")), "l_orderkey", "day")
    return found.groupBy("day").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).unionByName(orphans.agg(F.lit(None).cast("date").alias("day"), F.count("*").alias("n"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("quantity")))


def a4_approximate(spark, d):
    """Approximate counts of customers, which lie within a fifth of the exact ones."""
    (orders,) = read(spark, d, "orders")
    approx = aggregates.approx_distinct(orders, ["o_orderpriority"], "o_custkey", 0.02)
    exact = orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"))
    return approx.join(exact, "o_orderpriority").select("o_orderpriority", "exact", (F.abs(F.col("approx_o_custkey") - F.col("exact")) <= 0.2 * F.col("exact")).alias("near"))


def a14_quantiles(spark, d):
    """Approximate quantiles of the days from order to shipment: no further from the exact share than a hundredth."""
    items, orders = read(spark, d, "lineitem", "orders")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")
    q = aggregates.lateness_quantiles(both, "o_orderdate", "l_shipdate")  # one row
    late = F.col("l_shipdate").cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")
    share = lambda c, p: F.abs(F.avg((late <= F.col(c)).cast("int")) - p) <= 0.05
    return both.crossJoin(F.broadcast(q)).agg(share("p50", 0.5).alias("p50"), (F.avg((late <= F.col("p99")).cast("int")) >= 0.98).alias("p99"), F.count("*").alias("n"))


def x2_hot_keys(spark, d):
    return aggregates.hot_keys(read(spark, d, "events")[0], ["event_type"], 3).select("event_type", "n", F.round("share", 6).alias("share"))


def x3_skewed_and_healthy(spark, d):
    """Rows of a key that half of all rows were given, and rows over all partitions."""
    (orders,) = read(spark, d, "orders")
    hot = aggregates.inject_skew(orders, "o_custkey", 0.5, 1)
    health = aggregates.partition_health(orders.repartition(4))
    share = hot.agg((F.avg((F.col("o_custkey") == 1).cast("int")) > 0.4).alias("hot"))  # one row
    return health.crossJoin(F.broadcast(share)).select("n_rows", "partitions", "hot")


def x5_lineage_cut(spark, d):
    """Read by two aggregates, computed once."""
    days = cut(read(spark, d, "orders")[0].groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")), "days")
    top = days.agg(F.max("n").alias("most"))  # one row
    return days.crossJoin(F.broadcast(top)).where("n = most").select("day", "n")


# windows and order


def w2_ntile(spark, d):
    return read(spark, d, "part")[0].select("p_partkey", "p_brand", F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).alias("quarter"))


def w3_neighbours(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events")[0].select("event_id", F.lag("event_type", 1, "none").over(w).alias("before"), F.lead("event_type", 1, "none").over(w).alias("after"))


def w8_first_and_last(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return read(spark, d, "orders")[0].select("o_orderkey", F.first("o_orderkey").over(w).alias("first_order"), F.last("o_orderkey").over(w).alias("last_order"))


def w16_percent_of_maximum(spark, d):
    """Each brand's revenue in percent of the best one's; the maximum is one row, so no window over all rows is needed."""
    items, part = read(spark, d, "lineitem", "part")
    sums = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(money(net()).alias("revenue"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("revenue").alias("best")))).select("p_brand", F.round(100 * F.col("revenue") / F.col("best"), 4).alias("percent"))


def o2_null_order(spark, d):
    """The first ten parts when unknown sizes come last, and when they come first."""
    part = read(spark, d, "part")[0].select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).alias("size"))
    last = part.orderBy(F.asc_nulls_last("size"), "p_partkey").limit(10).withColumn("nulls", F.lit("last"))
    return last.unionByName(part.orderBy(F.desc_nulls_first("size"), "p_partkey").limit(10).withColumn("nulls", F.lit("first")))


# quality


def _holes(spark, d) -> DataFrame:
    """Orders with unknown statuses and dates."""
    return read(spark, d, "orders")[0].select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 1000, F.col("o_orderdate")).alias("day"), "o_totalprice")


def q1_filled(spark, d):
    return _holes(spark, d).fillna({"status": "?", "o_totalprice": 0.0}).select("o_orderkey", "status")


def q2_dropped(spark, d):
    h = _holes(spark, d)
    return h.dropna(subset=["status"]).select("o_orderkey", F.lit("subset").alias("way")).unionByName(h.dropna(thresh=3).select("o_orderkey", F.lit("thresh").alias("way")))


def q9_null_rate(spark, d):
    return quality.null_profile(_holes(spark, d)).select("column", "nulls", "percent", (F.col("percent") > 2).alias("too_many"))


def q10_fresh(spark, d):
    return quality.check_freshness(read(spark, d, "events")[0], "events", "ts", "2024-01-31 00:00:00", 24)


def q11_cast_survival(spark, d):
    e = read(spark, d, "events")[0].select(F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_id").cast("string")).alias("id"))
    return quality.qc_report(e, "events", quality.castable("id", "long"))


def q12_cross_columns(spark, d):
    items, orders = read(spark, d, "lineitem", "orders")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rules = {"shipped_has_date": (F.col("l_linestatus") == "F") & F.col("l_shipdate").isNull(), "shipped_after_order": F.col("l_shipdate") < F.col("o_orderdate"), "returned_was_shipped": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")}
    return quality.qc_report(both, "lineitem", rules)


def q13_contract(spark, d):
    """What differs between a table's columns and those that were agreed upon."""
    expected = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_comment", T.StringType())])
    return quality.check_schema(read(spark, d, "nation")[0], expected).select("column", "verdict")


def q14_volume(spark, d):
    """Orders of each month's last day against the mean of its days."""
    days = read(spark, d, "orders")[0].groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    history = days.select(F.lit("orders").alias("table_name"), F.col("n").alias("total_count"))
    return quality.check_volume(history, "orders", 1_000_000, 0.5)


def q18_trend(spark, d):
    """Reports of three days appended to a history, and its trend."""
    (orders,) = read(spark, d, "orders")
    at = _at(spark, "history")
    for day, low in (("2024-05-01", 0), ("2024-05-02", 1_000), ("2024-05-03", 10_000)):
        report = quality.qc_report(orders, "orders", quality.not_null("o_orderkey") | quality.in_range("o_totalprice", low))
        sinks.write_table(report.withColumn("run_ts", F.lit(day).cast("timestamp_ntz")), at, mode="append")
    return quality.quality_trend(spark.read.parquet(at))


def q19_reconciled(spark, d):
    """raw = without status + without date + orphans + loaded."""
    (customer,) = read(spark, d, "customer")
    known = customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    h = _holes(spark, d).join(read(spark, d, "orders")[0].select("o_orderkey", "o_custkey"), "o_orderkey").join(known, "o_custkey", "left")
    why = F.when(F.col("status").isNull(), "status").when(F.col("day").isNull(), "date").when(F.col("known").isNull(), "orphan").otherwise("loaded")
    n = h.groupBy(why.alias("why")).agg(F.count("*").alias("n"))
    return n.unionByName(h.agg(F.lit("raw").alias("why"), F.count("*").alias("n")))


def q20_layer_sums(spark, d):
    """Revenue of the items against that of the daily and the seller's mart: they agree to a cent a row."""
    from strata.plans import revenue

    items, orders = read(spark, d, "lineitem", "orders")
    base = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.sum(net()).cast("double").alias("items"))
    mart = revenue.seller_daily(items, orders).agg(F.sum("revenue").alias("mart"), F.count("*").alias("n"))
    return base.crossJoin(F.broadcast(mart)).select("n", (F.abs(F.col("items") - F.col("mart")) <= 0.01 * F.col("n")).alias("agree"))  # one row each


def q22_alerts(spark, d):
    """Checks that fail in the last of two runs alone."""
    (orders,) = read(spark, d, "orders")
    runs = [quality.qc_report(orders, "orders", quality.in_range("o_totalprice", low)).withColumn("run_ts", F.lit(day).cast("timestamp_ntz")) for day, low in (("2024-05-01", 0), ("2024-05-02", 10_000))]
    return quality.alerts(changes.union_all(runs)).select("check_name", "failed_count", "total_count")


def q23_shadow(spark, d):
    """A mart against the same one from a second run."""
    orders = read(spark, d, "orders")[0].select("o_orderkey", F.floor("o_totalprice").cast("double").alias("price"))
    return quality.compare_outputs(orders, orders.where("price >= 0"), ["price"]).select("figure", "same")


# changes and dimensions


def m5_upsert(spark, d):
    customer = read(spark, d, "customer")[0].select("c_custkey", "c_mktsegment")
    old = customer.where("c_mktsegment <> 'BUILDING'")
    return changes.upsert(old, customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").withColumn("c_mktsegment", F.lower("c_mktsegment")), ["c_custkey"])


def m7_deleted(spark, d):
    return changes.delete_where(read(spark, d, "orders")[0], F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


def d1_keys(spark, d):
    n = read(spark, d, "supplier")[0].select(F.col("s_suppkey").cast("string").alias("k"), F.nullif("s_nationkey", F.lit(0)).cast("string").alias("v"))
    return n.select("k", columns.surrogate_key("k", "v").alias("key"))


def _segments(spark, d) -> tuple[DataFrame, DataFrame]:
    customer = read(spark, d, "customer")[0].select("c_custkey", "c_mktsegment")
    return customer, customer.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "HOUSING").otherwise(F.col("c_mktsegment")))


def d3_overwritten(spark, d):
    return changes.scd1_apply(*_segments(spark, d), ["c_custkey"])


def d6_previous(spark, d):
    return changes.scd3_apply(*_segments(spark, d), ["c_custkey"], "c_mktsegment")


def d9_fact(spark, d):
    """Items with the keys of their day, part and seller. The long keys are made after the joins, so that none is shuffled."""
    items, orders, part, supplier = read(spark, d, "lineitem", "orders", "part", "supplier")
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    fact = joins.enrich(items, o, ("l_orderkey", "o_orderkey"), [(part.select("p_partkey"), "l_partkey", "p_partkey"), (supplier.select("s_suppkey"), "l_suppkey", "s_suppkey")])
    keys = {"date_key": F.date_format("day", "yyyyMMdd").cast("int"), "product_key": columns.surrogate_key("p_partkey"), "seller_key": columns.surrogate_key("s_suppkey")}
    return fact.withColumns(keys).select("l_orderkey", "l_linenumber", *keys, "l_quantity")


def d11_wide(spark, d):
    items, orders, part, supplier, nation = read(spark, d, "lineitem", "orders", "part", "supplier", "nation")
    wide = joins.enrich(items, orders, ("l_orderkey", "o_orderkey"), [(part, "l_partkey", "p_partkey"), (supplier, "l_suppkey", "s_suppkey"), (nation, "s_nationkey", "n_nationkey")])
    return wide.select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "n_name", "l_extendedprice")


def d12_order_facts(spark, d):
    """Items rolled up to orders; the grain is one row an order."""
    items = read(spark, d, "lineitem")[0].groupBy("l_orderkey").agg(F.count("*").alias("n_items"), money(net()).alias("revenue"))
    return joins.assert_unique(items, ["l_orderkey"])


def g4_one_day(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.where(F.to_date("o_orderdate") == F.lit("1995-03-15").cast("date")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("revenue"))


def g16_top_sellers(spark, d):
    from strata.plans import revenue

    sd = revenue.seller_daily(*read(spark, d, "lineitem", "orders"))
    return sd.groupBy("l_suppkey").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("n_orders").alias("orders")).orderBy(F.desc("revenue"), "l_suppkey").limit(10)


_QUERIES = (s1_csv, s3_dropped_rows, s7_json, s9_orc, s10_raw_lines, s11_merged_schema, k2_save_modes, k8_rows_a_file, k10_ranged_files, k17_small_files, k21_transformed_key, n5_nested_files, s16_temp_view, o7_union_all, j10_sql_hints, r2_expressions, r8_filters, r9_complement, r16_random_split, f2_dates, f3_math, f4_hashes, f6_arrays, f7_maps, n2_keep_empty, n4_flat_structs, j7_strategies, j13_duplicate_keys, j16_inherited_date, a4_approximate, a14_quantiles, x2_hot_keys, x3_skewed_and_healthy, x5_lineage_cut, w2_ntile, w3_neighbours, w8_first_and_last, w16_percent_of_maximum, o2_null_order, q1_filled, q2_dropped, q9_null_rate, q10_fresh, q11_cast_survival, q12_cross_columns, q13_contract, q14_volume, q18_trend, q19_reconciled, q20_layer_sums, q22_alerts, q23_shadow, m5_upsert, m7_deleted, d1_keys, d3_overwritten, d6_previous, d9_fact, d11_wide, d12_order_facts, g4_one_day, g16_top_sellers)
QUERIES = {f.__name__: f for f in _QUERIES}
_REPORT = "CASE WHEN failed_count = 0 THEN 'pass' ELSE 'fail' END AS status, failed_count, total_count, round(CASE WHEN total_count = 0 THEN 0 ELSE 100.0 * failed_count / total_count END, 4) AS failed_pct"
_HOLES = "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 1000 THEN o_orderdate END AS day, o_totalprice FROM orders)"
ORACLE_SQL = {
    "s1_csv": "SELECT * FROM customer",
    "s3_dropped_rows": "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS a FROM customer WHERE floor(c_acctbal) >= 0",
    "s7_json": "SELECT * FROM nation",
    "s9_orc": "SELECT * FROM supplier",
    "s10_raw_lines": "SELECT count(*) AS n_lines FROM part",
    "s11_merged_schema": "SELECT r_regionkey, r_name, NULL AS note FROM region UNION ALL SELECT r_regionkey, r_name, upper(r_name) FROM region",
    "k2_save_modes": "SELECT n_nationkey, CAST(2 AS BIGINT) AS copies FROM nation",
    "k8_rows_a_file": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS too_large FROM orders",
    "k10_ranged_files": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS overlaps FROM orders",
    "k17_small_files": "SELECT way, count(*) AS n_rows, true AS as_planned FROM orders, (VALUES ('key'), ('dealt'), ('one')) t(way) GROUP BY way",
    "k21_transformed_key": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-10' AND o_orderdate < TIMESTAMP '1995-03-20'",
    "n5_nested_files": "SELECT l_orderkey, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    "s16_temp_view": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "o7_union_all": "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
    "j10_sql_hints": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "r2_expressions": "SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 AS doubled, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part",
    "r8_filters": "SELECT p_partkey, p_size FROM part WHERE (starts_with(p_brand, 'Brand#1') OR (contains(p_name, 'a') AND regexp_matches(p_type, '^[A-M]') AND p_size BETWEEN 5 AND 40)) AND p_size NOT IN (7, 11)",
    "r9_complement": "SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE event_type <> 'purchase'",
    "r16_random_split": "SELECT count(*) AS n_rows, true AS about_right FROM lineitem",
    "f2_dates": "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, last_day(o_orderdate) AS month_end, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS age, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, strftime(o_orderdate, '%Y%m%d') AS key FROM orders",
    "f3_math": "SELECT c_custkey, abs(c_acctbal) AS size, ((CAST(floor(c_acctbal) AS BIGINT) % 7) + 7) % 7 AS rest, round(ln(1 + abs(c_acctbal)), 6) AS log, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(sign(c_acctbal) AS INTEGER) AS sign, greatest(c_acctbal, 0.0) AS least_zero FROM customer",
    "f4_hashes": "SELECT s_suppkey, md5(s_name) AS md5, sha256(s_name || '|' || s_nationkey) AS sha FROM supplier",
    "f6_arrays": "SELECT p_partkey, CAST(generate_subscripts(string_split(p_type, ' '), 1) - 1 AS INTEGER) AS pos, unnest(string_split(p_type, ' ')) AS word, CAST(length(unnest(string_split(p_type, ' '))) AS INTEGER) AS n FROM part",
    "f7_maps": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS kinds, count(*) AS total FROM orders GROUP BY 1",
    "n2_keep_empty": "SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "n4_flat_structs": "SELECT n_nationkey, n_name AS at_n_name, n_regionkey AS at_region_n_regionkey FROM nation",
    "j7_strategies": "SELECT n_name, strategy, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) t(strategy) GROUP BY 1, 2",
    "j13_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "j16_inherited_date": "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT NULL, count(*), coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "a4_approximate": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY 1",
    "a14_quantiles": "SELECT true AS p50, true AS p99, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "x2_hot_keys": "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "x3_skewed_and_healthy": "SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS partitions, true AS hot FROM orders",
    "x5_lineage_cut": "WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM n WHERE n = (SELECT max(n) FROM n)",
    "w2_ntile": "SELECT p_partkey, p_brand, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS quarter FROM part",
    "w3_neighbours": "SELECT event_id, lag(event_type, 1, 'none') OVER w AS before, lead(event_type, 1, 'none') OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "w8_first_and_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w16_percent_of_maximum": f"WITH s AS (SELECT p_brand, CAST(round(sum({_NET}), 2) AS DOUBLE) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, round(100 * r / (SELECT max(r) FROM s), 4) AS percent FROM s",
    "o2_null_order": "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_size END AS size FROM part) SELECT * FROM (SELECT *, 'last' AS nulls FROM p ORDER BY size ASC NULLS LAST, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'first' AS nulls FROM p ORDER BY size DESC NULLS FIRST, p_partkey LIMIT 10)",
    "q1_filled": f"SELECT o_orderkey, coalesce(status, '?') AS status FROM {_HOLES}",
    "q2_dropped": f"SELECT o_orderkey, 'subset' AS way FROM {_HOLES} WHERE status IS NOT NULL UNION ALL SELECT o_orderkey, 'thresh' FROM {_HOLES} WHERE status IS NOT NULL OR day IS NOT NULL",
    "q9_null_rate": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 4) AS percent, round(100.0 * (count(*) - count({c})) / count(*), 4) > 2 AS too_many FROM {_HOLES}" for c in ("o_orderkey", "status", "day", "o_totalprice")),
    "q10_fresh": f"SELECT 'events' AS table_name, 'ts_fresh' AS check_name, {_REPORT} FROM (SELECT CASE WHEN TIMESTAMP '2024-01-31' - max(ts) <= INTERVAL 24 HOURS THEN CAST(0 AS BIGINT) ELSE 1 END AS failed_count, CAST(1 AS BIGINT) AS total_count FROM events)",
    "q11_cast_survival": f"SELECT 'events' AS table_name, 'id_as_long' AS check_name, {_REPORT} FROM (SELECT count(*) FILTER (WHERE event_type = 'error') AS failed_count, count(*) AS total_count FROM events)",
    "q12_cross_columns": f"WITH b AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT 'shipped_has_date' AS check_name, count(*) FILTER (WHERE l_linestatus = 'F' AND l_shipdate IS NULL) AS failed_count, count(*) AS total_count FROM b UNION ALL SELECT 'shipped_after_order', count(*) FILTER (WHERE l_shipdate < o_orderdate), count(*) FROM b UNION ALL SELECT 'returned_was_shipped', count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O'), count(*) FROM b) SELECT 'lineitem' AS table_name, check_name, {_REPORT} FROM r",
    "q13_contract": "SELECT * FROM (VALUES ('n_nationkey', 'type'), ('n_comment', 'missing'), ('n_regionkey', 'extra')) t(\"column\", verdict)",
    "q14_volume": f"WITH m AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))) SELECT 'orders' AS table_name, 'volume' AS check_name, {_REPORT} FROM (SELECT CASE WHEN abs(1000000 - m) > 0.5 * m THEN CAST(1 AS BIGINT) ELSE 0 END AS failed_count, CAST(1 AS BIGINT) AS total_count FROM m)",
    "q18_trend": "SELECT day, 'orders' AS table_name, CAST(2 AS BIGINT) AS checks, CAST((SELECT count(*) FROM orders WHERE o_totalprice < low) > 0 AS BIGINT) AS failed FROM (VALUES (DATE '2024-05-01', 0), (DATE '2024-05-02', 1000), (DATE '2024-05-03', 10000)) t(day, low)",
    "q19_reconciled": f"WITH h AS (SELECT CASE WHEN status IS NULL THEN 'status' WHEN day IS NULL THEN 'date' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'orphan' ELSE 'loaded' END AS why FROM {_HOLES}) SELECT why, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT 'raw', count(*) FROM h",
    "q20_layer_sums": "SELECT count(*) AS n, true AS agree FROM (SELECT DISTINCT l_suppkey, CAST(o_orderdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "q22_alerts": "SELECT 'o_totalprice_range' AS check_name, count(*) FILTER (WHERE o_totalprice < 10000) AS failed_count, count(*) AS total_count FROM orders HAVING count(*) FILTER (WHERE o_totalprice < 10000) > 0 AND count(*) FILTER (WHERE o_totalprice < 0) = 0",
    "q23_shadow": "SELECT figure, true AS same FROM (VALUES ('n_rows'), ('price'), ('checksum')) t(figure)",
    "m5_upsert": "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "m7_deleted": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'",
    "d1_keys": "SELECT CAST(s_suppkey AS VARCHAR) AS k, sha256(s_suppkey || chr(31) || coalesce(CAST(nullif(s_nationkey, 0) AS VARCHAR), chr(0))) AS key FROM supplier",
    "d3_overwritten": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "d6_previous": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS previous_c_mktsegment FROM customer",
    "d9_fact": "SELECT l_orderkey, l_linenumber, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, sha256(CAST(l_partkey AS VARCHAR)) AS product_key, sha256(CAST(l_suppkey AS VARCHAR)) AS seller_key, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
    "d11_wide": "SELECT l_orderkey, l_linenumber, o_orderstatus, p_brand, n_name, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "d12_order_facts": f"SELECT l_orderkey, count(*) AS n_items, CAST(round(sum({_NET}), 2) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1",
    "g4_one_day": "SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS revenue FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15'",
    "g16_top_sellers": f"WITH s AS (SELECT l_suppkey, CAST(o_orderdate AS DATE) AS d, CAST(round(sum({_NET}), 2) AS DOUBLE) AS r, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT l_suppkey, round(sum(r), 2) AS revenue, CAST(sum(n) AS BIGINT) AS orders FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
}
