"""Streams: sources, event time, windows, joins, state, sinks and their figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A record of a log broker, as its connector gives it.
BROKER = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType())])


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A folder that files arrive in."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def broker_options(servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None, fail_on_loss: bool = True) -> dict[str, str]:
    """Options of the broker's connector, where it is installed."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(fail_on_loss).lower()}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def decode_records(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Broker records with their value parsed as `data`; `bad` marks those that don't fit the schema."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("data", F.from_json(F.col("value").cast("string"), full, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("value").isNull() | F.col("data._corrupt_record").isNotNull()
    return parsed.select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset", "timestamp", "value", F.col("data").dropFields("_corrupt_record").alias("data"), bad.alias("bad"))


def encode_records(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark on the event time, which must be a timestamp of an instant."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def drop_future(df: DataFrame, column: str, tolerance: str) -> DataFrame:
    """Rows from the future would move the watermark past all others; this goes before it."""
    return df.where(F.col(column).cast("timestamp") <= F.current_timestamp() + F.expr(f"INTERVAL {tolerance}"))


def windowed(df: DataFrame, column: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    return df.groupBy(w.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *(c for c in _names(aggregates)))


def sessions(df: DataFrame, column: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Windows that last while events follow one another within the gap."""
    return df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *(c for c in _names(aggregates)))


def _names(aggregates: list[Column]) -> list[str]:
    return [str(a._jc.toString()).rsplit(" AS ", 1)[-1].strip("`") for a in aggregates]


def dedup_stream(df: DataFrame, keys: list[str], column: str, ttl: str, within: bool = False) -> DataFrame:
    """The first row of each key and event time; within: of each key, whatever the event time, for the ttl."""
    marked = with_event_time(df, column, ttl)
    return marked.dropDuplicatesWithinWatermark(keys) if within else marked.dropDuplicates([*keys, column])


def interval_join(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str, bound: str, delays: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of b up to `bound` after those of a with the same key. Both have watermarks, so that state ends; outer
    rows come once the watermark has passed the bound."""
    left, right = with_event_time(a, a_time, delays[0]), with_event_time(b.withColumnRenamed(key, f"_{key}"), b_time, delays[1])
    on = (F.col(key) == F.col(f"_{key}")) & (F.col(b_time) >= F.col(a_time)) & (F.col(b_time) <= F.col(a_time) + F.expr(f"INTERVAL {bound}"))
    return left.join(right, on, how)


def enrich_stream(stream: DataFrame, static: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A stream with a static table; the stream is the side that is kept."""
    return stream.join(static, key, how)


SESSION = "user_id long, session_start timestamp, session_end timestamp, n_events long, is_final boolean"


def sessionize(df: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a stream with a watermark: a session ends when an event comes more than the gap after the last, or
    when the watermark has passed that time. A batch may hold several sessions of a user, in any order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            first, last, n = state.get
            out.append((key[0], first, last, n, True))
            state.remove()
        else:
            times = sorted(t for f in frames for t in f["_at"].tolist())
            now = list(state.get) if state.exists else None
            for t in times:
                if now is None or t - now[1] > gap_seconds * 1_000_000:
                    if now is not None:
                        out.append((key[0], *now, True))
                    now = [t, t, 0]
                now = [min(now[0], t), max(now[1], t), now[2] + 1]
            if now is not None:
                end = now[1] // 1000 + gap_seconds * 1000
                if end > state.getCurrentWatermarkMs():
                    state.update(tuple(now))
                    state.setTimeoutTimestamp(end)
                else:
                    out.append((key[0], *now, True))
                    state.remove() if state.exists else None
        rows = pd.DataFrame(out, columns=["user_id", "session_start", "session_end", "n_events", "is_final"])
        for c in ("session_start", "session_end"):
            rows[c] = pd.to_datetime(rows[c], unit="us", utc=True)
        yield rows

    # pandas would see the session's wall clock, which the watermark knows nothing of
    return df.withColumn("_at", F.unix_micros(ts)).groupBy(user).applyInPandasWithState(step, SESSION, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch, into sink(batch, number), and stops."""
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch replaces the folder of its own number, so that its replay adds nothing."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several sinks of one batch, which is computed once."""

    def sink(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            for s in sinks:
                s(df, n)
        finally:
            df.unpersist()

    return sink


def upsert_sink(root: str, keys: list[str], order: list[str], n_buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Upserts each batch into a table of buckets, of which it rewrites those that its keys fall into. A batch that was published
    before is left out on replay. sources.buckets reads the table."""
    from strata.sources.buckets import merge_buckets

    def sink(df: DataFrame, n: int) -> None:
        merge_buckets(df, root, keys, order, n_buckets, f"batch {n}")

    return sink


def score(df: DataFrame, rules: dict[str, tuple[Column, int]], high: int = 70) -> DataFrame:
    """A flag for each rule, the sum of the points of those that hold, and a level."""
    flags = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, (c, _) in rules.items()})
    total = sum((F.col(k).cast("int") * p for k, (_, p) in rules.items()), F.lit(0))
    return flags.withColumn("score", total).withColumn("level", F.when(F.col("score") >= high, "high").when(F.col("score") > 0, "low").otherwise("none"))
