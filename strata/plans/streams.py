"""Streams over the events table, run to its end; what they give is the same as a batch would."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import shared_dir
from strata.streaming import events as st


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return st.read_stream(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str) -> DataFrame:
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/strata-stream-{uuid.uuid4().hex}"
    # in complete mode each batch holds the whole result, so the last one replaces the others
    sink = st.table_sink(f"{at}/out") if mode != "complete" else lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out")
    st.run_available(df, sink, f"{at}/checkpoint", mode)
    return spark.read.parquet(f"{at}/out")


def t10_tumbling(spark, d):
    counts = st.windowed(_events(spark, d), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return _run(counts, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def t8_running_counts(spark, d):
    return _run(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "complete").select("event_type", "n")


def t12_sessions(spark, d):
    found = st.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return _run(found, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def t16_dedup(spark, d):
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(st.dedup_stream(twice, ["event_id"], "ts", "365 days").groupBy("event_type").agg(F.count("*").alias("n")), "complete").select("event_type", "n")


def t35_scoring(spark, d):
    rules = {"purchase": (F.col("event_type") == "purchase", 40), "large": (F.col("value") > 50, 40), "night": (F.hour("ts") < 6, 20)}
    return _run(st.score(_events(spark, d), rules), "append").select("event_id", "purchase", "large", "night", "score", "level")


QUERIES = {f.__name__: f for f in (t8_running_counts, t10_tumbling, t12_sessions, t16_dedup, t35_scoring)}
ORACLE_SQL = {
    "t8_running_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "t10_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "t12_sessions": "WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "t16_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "t35_scoring": "WITH f AS (SELECT event_id, coalesce(event_type = 'purchase', false) AS purchase, coalesce(value > 50, false) AS large, coalesce(hour(ts) < 6, false) AS night FROM events), s AS (SELECT *, CAST(purchase AS INTEGER) * 40 + CAST(large AS INTEGER) * 40 + CAST(night AS INTEGER) * 20 AS score FROM f) SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM s",
}
