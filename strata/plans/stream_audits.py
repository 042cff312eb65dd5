"""Streams with what proves them: late rows, each row once, buckets that a batch rewrites, and rules over their progress."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.revenue import read
from strata.session import shared_dir
from strata.sources import buckets
from strata.streaming import audit, health
from strata.streaming import events as st

DROPS = 4


def _root(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strata-{label}-{uuid.uuid4().hex}"


def in_drops(rows: DataFrame, number: Column, n: int, root: str, each) -> None:
    """Lands the rows in n drops, one after another, by their number, and has `each` stream what is there after each."""
    spark, at = rows.sparkSession, f"{root}/landing"
    for k in range(n):
        rows.where(number == k).write.mode("append").parquet(at)
        each(st.read_stream(spark, at, rows.schema), k)


def _arriving(events: DataFrame) -> tuple[DataFrame, Column]:
    """Events with the time at which they come: every tenth three days late, every seventh twelve hours, and their drop by that."""
    late = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 3 DAYS")).when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrived", F.unix_micros(F.col("ts") + late))
    ends = rows.agg(F.min("arrived").alias("low"), F.max("arrived").alias("high")).collect()[0]
    low, high = ends["low"] or 0, ends["high"] or 0
    return rows, F.expr(f"(arrived - {low}L) * {DROPS}L div {high - low + 1}L")


def t13_late_audit(spark, d):
    """Rows later than a day go to a side table; with those that are accepted they are all rows."""
    root, (events,) = _root(spark, "late"), read(spark, d, "events")
    rows, number = _arriving(events)
    sink = audit.late_sink(root, "ts", datetime.timedelta(days=1), st.table_sink(f"{root}/accepted"))
    in_drops(rows, number, DROPS, root, lambda stream, k: st.run_available(stream, sink, f"{root}/checkpoint"))
    accepted = spark.read.parquet(f"{root}/accepted").groupBy("batch").agg(F.count("*").alias("n_accepted"))
    out = audit.late_report(spark, root, "ts").join(accepted, "batch", "left")
    return out.select(F.col("batch").cast("long").alias("batch"), "n_rows", "n_late", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), F.col("watermark").cast("timestamp_ntz").alias("watermark"), "worst_ms")


def t28_bucket_upserts(spark, d):
    """Each customer's last order, from a stream in drops."""
    root, (orders,) = _root(spark, "upserts"), read(spark, d, "orders")
    sink = st.upsert_sink(root, ["o_custkey"], ["o_orderdate", "o_orderkey"], 16)
    in_drops(orders, F.col("o_orderkey") % 3, 3, root, lambda stream, k: st.run_available(stream, sink, f"{root}/checkpoint"))
    return buckets.read_buckets(spark, root).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def t31_exactly_once(spark, d):
    """The stream breaks down in its second batch, after the rows were written, and runs again: by batch number they are there once, by
    plain appends twice."""
    root, (orders,) = _root(spark, "once"), read(spark, d, "orders")
    rows, broken = orders.select("o_orderkey", "o_totalprice"), []

    def break_down(batch: DataFrame, n: int) -> None:
        if n == 1 and not broken:
            broken.append(n)
            raise RuntimeError("broken down before the commit")

    append = lambda batch, n: batch.write.mode("append").parquet(f"{root}/append")
    sink = st.fan_out(audit.ledger_sink(root, ["o_orderkey"], st.table_sink(f"{root}/by_batch")), append, break_down)

    def each(stream: DataFrame, k: int) -> None:
        try:
            st.run_available(stream, sink, f"{root}/checkpoint")
        except StreamingQueryException:
            st.run_available(stream, sink, f"{root}/checkpoint")

    in_drops(rows, F.col("o_orderkey") % 3, 3, root, each)
    both = [audit.exactly_once(spark, root, spark.read.parquet(f"{root}/{way}"), ["o_orderkey"]).withColumn("way", F.lit(way)) for way in ("by_batch", "append")]
    return both[0].unionByName(both[1]).select("way", "batches", "unfinished", "noted", "total", "distinct", "exactly_once")


def t32_progress(spark, d):
    """What the listener says of two streams over the events in drops: distinct users without a watermark, whose state only grows, and
    distinct events within a watermark, whose state is cleared."""
    root, (events,) = _root(spark, "progress"), read(spark, d, "events")
    rows, number = _arriving(events)
    found = _logged(spark, root, rows, number, DROPS)
    return found.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.max("state_rows").alias("most_state"), (F.sum("removed_rows") > 0).alias("removes"))


def _logged(spark: SparkSession, root: str, rows: DataFrame, number: Column, n: int) -> DataFrame:
    log = health.ProgressLog()
    spark.streams.addListener(log)

    def each(stream: DataFrame, k: int) -> None:
        ways = {"users": stream.dropDuplicates(["user_id"]), "events": st.dedup_stream(stream, ["event_id"], "ts", "30 minutes")}
        for name, df in ways.items():
            df.writeStream.queryName(f"{name}-{uuid.uuid4().hex}").foreachBatch(st.table_sink(f"{root}/{name}")).option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        log.write(spark, f"{root}/progress")

    try:
        in_drops(rows, number, n, root, each)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        log.write(spark, f"{root}/progress")
    finally:
        spark.streams.removeListener(log)
    return spark.read.parquet(f"{root}/progress").withColumn("name", F.substring_index("name", "-", 1))


def t33_health(spark, d):
    """Rules over that progress, of one run each: a stream without a watermark keeps what it has, one with a watermark doesn't."""
    root, (events,) = _root(spark, "health"), read(spark, d, "events")
    rows, number = _arriving(events)
    # the runs of one checkpoint are one stream
    found = _logged(spark, root, rows, number, DROPS).withColumn("run", F.col("name"))
    flags = health.health(found, trigger_ms=86_400_000, window=DROPS - 1, behind_ms=0)
    return health.verdicts(flags).where("rule IN ('slow', 'no_removals')").select("name", "rule", (F.col("fired") > 0).alias("fired"))


_ARRIVING = f"WITH a AS (SELECT *, ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 3 DAYS WHEN event_id % 7 = 0 THEN INTERVAL 12 HOURS ELSE INTERVAL 0 HOURS END AS arrived FROM events), b AS (SELECT *, epoch_us(arrived) AS us, min(epoch_us(arrived)) OVER () AS low, max(epoch_us(arrived)) OVER () AS high FROM a), c AS (SELECT *, CAST((us - low) * {DROPS} // (high - low + 1) AS BIGINT) AS batch FROM b)"
QUERIES = {f.__name__: f for f in (t13_late_audit, t28_bucket_upserts, t31_exactly_once, t32_progress, t33_health)}
ORACLE_SQL = {
    "t13_late_audit": f"{_ARRIVING}, m AS (SELECT batch, max(epoch_us(ts) // 1000) AS newest FROM c GROUP BY 1), w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS mark FROM m), l AS (SELECT c.batch, mark, ts, mark IS NOT NULL AND epoch_us(ts) <= mark * 1000 AS late FROM c JOIN w USING (batch)) SELECT batch, count(*) AS n_rows, count(*) FILTER (WHERE late) AS n_late, count(*) FILTER (WHERE NOT late) AS n_accepted, make_timestamp(any_value(mark) * 1000) AS watermark, max(mark - epoch_us(ts) // 1000) FILTER (WHERE late) AS worst_ms FROM l GROUP BY batch",
    "t28_bucket_upserts": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "t31_exactly_once": "WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS twice, count(DISTINCT o_orderkey) AS keys FROM orders) SELECT 'by_batch' AS way, CAST(3 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS unfinished, n AS noted, n AS total, keys AS distinct, n = keys AS exactly_once FROM n UNION ALL SELECT 'append', 3, 0, n, n + twice, keys, twice = 0 AND n = keys FROM n",
    "t32_progress": f"{_ARRIVING}, k AS (SELECT batch, max(epoch_us(ts) // 1000) AS newest FROM c GROUP BY 1) SELECT 'users' AS name, count(*) AS n_rows, count(DISTINCT user_id) AS most_state, false AS removes FROM events UNION ALL SELECT 'events', (SELECT count(*) FROM events), max(n), true FROM (SELECT m.batch, count(*) AS n FROM (SELECT batch, coalesce(max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1800000, 0) AS mark FROM k) m JOIN c ON c.batch <= m.batch AND epoch_us(ts) > mark * 1000 GROUP BY 1)",
    "t33_health": "SELECT * FROM (VALUES ('users', 'slow', false), ('users', 'no_removals', true), ('events', 'slow', false), ('events', 'no_removals', false)) v(name, rule, fired) WHERE EXISTS (SELECT 1 FROM events)",
}
