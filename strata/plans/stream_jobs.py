"""Whole stream jobs over the given tables, run to their end and compared with what a batch would give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.revenue import read
from strata.plans.streams import _events, _run
from strata.plans.tables import ORACLE_SQL as BATCH_SQL
from strata.session import shared_dir
from strata.streaming import events as st
from strata.streaming import jobs

KINDS = ["view", "click", "purchase"]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strata-job-{uuid.uuid4().hex}"


def _paths(spark: SparkSession, d: str, drafts: bool) -> DataFrame:
    df = jobs.session_paths(st.with_event_time(_events(spark, d), "ts", "1 hour"), "user_id", "ts", "event_type", "event_type", KINDS, 1800, drafts)
    out = _run(df, "update" if drafts else "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def t19_session_paths(spark, d):
    """Sessions that the watermark has passed."""
    return _paths(spark, d, False).select("user_id", "session_start", "session_end", "n_events", *(f"n_{k}" for k in KINDS), F.array_join("path", ">").alias("path"))


def t40_session_drafts(spark, d):
    """Open sessions too, as drafts."""
    return _paths(spark, d, True).select("user_id", "session_start", "n_events", "is_final")


def t20_track_history(spark, d):
    """The type of an event stands for its place."""
    df = jobs.track_history(st.with_event_time(_events(spark, d), "ts", "1 hour"), "user_id", "event_id", "ts", "value", "event_type")
    return _run(df, "append").select("user_id", "event_id", "n_recent", "moved", F.round("mean_before", 6).alias("mean_before"))


def t23_enriched_stream(spark, d):
    customer = read(spark, d, "customer")[0].select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = st.enrich_stream(_events(spark, d), customer, "user_id")
    return _run(joined.select("event_id", "user_id", "c_mktsegment"), "append").select("event_id", "user_id", "c_mktsegment")


def t25_interval_join(spark, d):
    """Purchases up to an hour after a click of the same user."""
    clicks = _events(spark, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = _events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    joined = st.interval_join(clicks, bought, "user_id", "click_ts", "purchase_ts", "1 hour", ("1 hour", "1 hour"))
    return _run(joined.select("click_id", "purchase_id"), "append").select("click_id", "purchase_id")


def t30_outbox(spark, d):
    root = _root(spark)
    orders = read(spark, d, "orders")[0].select("o_orderkey", "o_orderstatus")
    jobs.outbox(orders, root, "o_orderkey")
    return jobs.pending(spark, root, 0).select("version", "key", F.get_json_object("value", "$.o_orderstatus").alias("status"))


def t37_alert_recall(spark, d):
    root = _root(spark)
    rules = {"purchase": (F.col("event_type") == "purchase", 40), "large": (F.col("value") > 50, 40)}
    jobs.alert_job(_events(spark, d), rules, root, f"{root}/checkpoint")
    injected = read(spark, d, "events")[0].where("value > 40").select("event_id", "event_type")
    return jobs.recall(spark.read.parquet(f"{root}/alerts"), injected, "event_id", "event_type")


ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])


def _change_job(spark: SparkSession, d: str) -> str:
    """The orders as a stream of change envelopes: each sets its customer's state, and every 7th removes it."""
    orders = st.read_stream(spark, d, spark.read.parquet(f"{d}/orders.parquet").schema, glob="orders.parquet")
    row, gone = F.struct(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice"), F.col("o_orderkey") % 7 == 0
    day = F.unix_date(F.to_date("o_orderdate")).cast("long").alias("ts_ms")
    parts = [F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), day, F.struct(day, F.col("o_orderkey").alias("lsn"), F.lit("orders").alias("table")).alias("source")]
    root = _root(spark)
    jobs.cdc_job(orders.select(F.to_json(F.struct(*parts)).alias("value")), root, f"{root}/checkpoint", ROW, ["k"])
    return root


def t39_change_replica(spark, d):
    return jobs.replica(spark, _change_job(spark, d))


def t39_change_history(spark, d):
    return jobs.replica_history(spark, _change_job(spark, d), ["k"], ["o_orderstatus"])


def t41_reconciled_days(spark, d):
    """A stream that lost its errors, against the whole days."""
    streamed = _run(_events(spark, d).where("event_type <> 'error' OR value < 100"), "append")
    days = [df.select(F.to_date("ts").alias("day"), "event_type", "value") for df in (streamed, read(spark, d, "events")[0])]
    return jobs.reconcile_day(*days, "day", ["event_type"], "value")


_SESSIONS = "WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m), z AS (SELECT user_id, g, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM s GROUP BY 1, 2), f AS (SELECT *, g = max(g) OVER (PARTITION BY user_id) AS is_last, g < max(g) OVER (PARTITION BY user_id) OR epoch_ms(session_end) + 1800000 < (SELECT epoch_ms(max(ts)) FROM events) - 3600000 AS done FROM z)"
_PAST = "SELECT *, list({'t': ts, 'v': value, 'p': event_type}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM events"
QUERIES = {f.__name__: f for f in (t19_session_paths, t20_track_history, t23_enriched_stream, t25_interval_join, t30_outbox, t37_alert_recall, t39_change_replica, t39_change_history, t40_session_drafts, t41_reconciled_days)}
ORACLE_SQL = {
    "t19_session_paths": f"{_SESSIONS} SELECT user_id, session_start, session_end, n_events, n_view, n_click, n_purchase, path FROM f WHERE done",
    "t20_track_history": f"WITH a AS ({_PAST}), b AS (SELECT *, list_filter(coalesce(h, []), lambda x: ts - x.t <= INTERVAL 24 HOURS) AS q FROM a) SELECT user_id, event_id, 1 + len(list_filter(q, lambda x: ts - x.t <= INTERVAL 10 MINUTES)) AS n_recent, coalesce(ts - q[-1].t < INTERVAL 1 HOUR AND q[-1].p <> event_type, false) AS moved, round(list_avg(list_transform(q, lambda x: x.v)), 6) AS mean_before FROM b",
    "t23_enriched_stream": "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey",
    "t25_interval_join": "SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "t30_outbox": "SELECT CAST(1 AS BIGINT) AS version, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders",
    "t37_alert_recall": "SELECT event_type, count(*) AS injected, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS found, round(count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) / count(*), 6) AS recall FROM events WHERE value > 40 GROUP BY 1",
    "t39_change_replica": BATCH_SQL["m8_current_state"],
    "t39_change_history": BATCH_SQL["d5_history"],
    "t40_session_drafts": f"{_SESSIONS} SELECT user_id, session_start, n_events, true AS is_final FROM f WHERE done UNION ALL SELECT user_id, session_start, n_events, false FROM f WHERE is_last",
    "t41_reconciled_days": "WITH w AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_whole, round(sum(value), 4) AS whole, nullif(count(*) FILTER (WHERE event_type <> 'error' OR value < 100), 0) AS n_streamed, round(sum(value) FILTER (WHERE event_type <> 'error' OR value < 100), 4) AS streamed FROM events GROUP BY 1, 2) SELECT *, n_streamed IS NOT DISTINCT FROM n_whole AND streamed IS NOT DISTINCT FROM whole AS agrees FROM w",
}
