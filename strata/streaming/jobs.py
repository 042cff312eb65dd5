"""Whole jobs over streams: sessions with paths, histories per key, change data, outbox, alerts, lag, reconciliation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strata.operators import changes
from strata.sources import buckets, versions
from strata.streaming import events as st


def session_paths(df: DataFrame, user: str, ts: str, kind: str, page: str, kinds: list[str], gap_seconds: int, drafts: bool = False) -> DataFrame:
    """Sessions of a stream with a watermark: how many events of each kind, and the pages in turn.

    A session is final once an event comes more than the gap after its last, or the watermark has passed that time.
    drafts: open sessions too, after each batch that they change in, with is_final false. Events of kinds that are not
    named count in n_events alone; null pages are left out of the path."""
    names = ["user_id", "session_start", "session_end", "n_events", *(f"n_{k}" for k in kinds), "path", "is_final"]
    schema = ", ".join(["user_id long, session_start long, session_end long, n_events long", *(f"n_{k} long" for k in kinds), "path array<string>, is_final boolean"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def give(s: dict, final: bool) -> None:
            out.append((key[0], s["first"], s["last"], s["n"], *(s["kinds"].get(k, 0) for k in kinds), s["path"], final))

        now = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            give(now, True)
            state.remove()
        else:
            rows = sorted(((t, k, p) for f in frames for t, k, p in zip(f["_at"].tolist(), f[kind], f[page], strict=True)), key=lambda r: (r[0], str(r[1]), str(r[2])))
            for t, k, p in rows:
                if now is not None and t - now["last"] > gap_seconds * 1_000_000:
                    give(now, True)
                    now = None
                now = now or {"first": t, "last": t, "n": 0, "kinds": {}, "path": []}
                now["first"], now["last"], now["n"] = min(now["first"], t), max(now["last"], t), now["n"] + 1
                now["kinds"][k] = now["kinds"].get(k, 0) + 1
                now["path"] += [p] if p is not None else []
            end = now["last"] // 1000 + gap_seconds * 1000
            if end > state.getCurrentWatermarkMs():
                state.update((json.dumps(now),))
                state.setTimeoutTimestamp(end)
                if drafts:
                    give(now, False)
            else:
                give(now, True)
                if state.exists:
                    state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    mode = "update" if drafts else "append"
    # pandas would see the session's wall clock, which the watermark knows nothing of; and each group's times would take longer to convert than all else.
    # ts itself goes along, as the watermark is on it
    rows = df.select(*dict.fromkeys([user, ts, kind, page]), F.unix_micros(ts).alias("_at"))
    found = rows.groupBy(user).applyInPandasWithState(step, schema, "open string", mode, GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("session_start", "session_end")})


HISTORY = "user_id long, event_id long, ts timestamp, amount double, n_recent long, moved boolean, mean_before double"


def track_history(df: DataFrame, user: str, event: str, ts: str, amount: str, place: str, keep: int = 10, hours: int = 24, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """For each event of a stream with a watermark on ts what its user's history says: events in the 10 minutes up to it, whether the last
    event within an hour was elsewhere, and the mean amount before it. The state is the last `keep` events of at most
    `hours` hours, and goes once the watermark is ttl_ms past the last. (A timeout by the clock would have a stream
    that runs over what is there never end.) Null places are one place, and rows later than the watermark don't count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            past = json.loads(state.get[0]) if state.exists else []
            rows = sorted((t, e, a, p) for f in frames for t, e, a, p in zip(f["_at"].tolist(), f[event].tolist(), f[amount].tolist(), f[place].fillna("").tolist(), strict=True))
            for t, e, a, p in rows:
                past = [x for x in past if t - x[0] <= hours * 3_600_000_000]
                recent = 1 + sum(t - x[0] <= 600_000_000 for x in past)
                moved = bool(past) and t - past[-1][0] < 3_600_000_000 and past[-1][2] != p
                out.append((key[0], e, t, a, recent, moved, sum(x[1] for x in past) / len(past) if past else None))
                past = [*past, (t, a, p)][-keep:]
            state.update((json.dumps(past),))
            state.setTimeoutTimestamp(max(past[-1][0] // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        got = pd.DataFrame(out, columns=["user_id", "event_id", "ts", "amount", "n_recent", "moved", "mean_before"])
        got["ts"] = pd.to_datetime(got["ts"], unit="us", utc=True)
        got["mean_before"] = got["mean_before"].astype("float64")
        yield got

    # pandas would see the session's wall clock, which the watermark knows nothing of
    return df.withColumn("_at", F.unix_micros(ts)).groupBy(user).applyInPandasWithState(step, HISTORY, "past string", "append", GroupStateTimeout.EventTimeTimeout)


def behaviour_rules() -> dict[str, tuple[Column, int]]:
    """Rules over track_history()'s columns, for events.score()."""
    return {"burst": (F.col("n_recent") >= 5, 40), "moved": (F.col("moved"), 40), "large": (F.col("amount") > 5 * F.col("mean_before"), 40)}


class Refreshing:
    """A static table that is loaded again when it is older than ttl seconds; call it inside a sink."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.at: float | None = None
        self.table: DataFrame | None = None

    def __call__(self) -> DataFrame:
        if self.at is None or self.clock() - self.at >= self.ttl:
            old, self.table, self.at = self.table, self.load().persist(), self.clock()
            if old is not None:
                old.unpersist()
        return self.table


def outbox(df: DataFrame, root: str, key: str, note: str = "") -> int:
    """Publishes rows and the messages about them in one version: either both are there or neither."""
    rows = df.withColumns({"message_key": F.col(key).cast("string"), "message": F.to_json(F.struct(*df.columns))})
    return versions.publish(rows, root, note)


def pending(spark: SparkSession, root: str, sent: int) -> DataFrame:
    """version, key and value of the messages of all versions after the one that was sent last."""
    after = [r["version"] for r in versions.history(spark, root).where(F.col("version") > sent).select("version").collect()]  # a row a version
    parts = [versions.read_version(spark, root, v).select(F.lit(v).cast("long").alias("version"), F.col("message_key").alias("key"), F.col("message").alias("value")) for v in after]
    return changes.union_all(parts) if parts else spark.createDataFrame([], "version long, key string, value string")


def bronze_stream(records: DataFrame, path: str, checkpoint: str) -> None:
    """Appends raw broker records with their coordinates, in folders by day of arrival; nothing is parsed or dropped."""
    rows = records.select("key", "value", "topic", "partition", "offset", "timestamp", F.to_date("timestamp").alias("day"), F.current_timestamp().alias("ingested_at"))
    rows.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cdc_job(envelopes: DataFrame, root: str, checkpoint: str, row: T.StructType, keys: list[str], n_buckets: int = 64) -> None:
    """Change envelopes (JSON in `value`) into a replica and a change log, batch by batch.

    The replica is a table of buckets, and a batch rewrites those of its keys. It keeps the last change of each key, deletes as well,
    so that a change that arrives late can't undo a newer one. A batch that comes again replaces its own part of the log and
    changes nothing in the replica."""

    def sink(batch: DataFrame, n: int) -> None:
        part = f"{root}/changes/batch={n}"
        changes.flatten_changes(changes.parse_changes(batch, "value", row)).write.mode("overwrite").parquet(part)
        buckets.merge_buckets(batch.sparkSession.read.parquet(part), f"{root}/replica", keys, ["ts_ms", "lsn"], n_buckets, f"batch {n}")

    st.run_available(envelopes, sink, checkpoint)


def replica(spark: SparkSession, root: str) -> DataFrame:
    """The table as it stands after cdc_job()."""
    return buckets.read_buckets(spark, f"{root}/replica").where("op <> 'd'").drop("op", "ts_ms", "lsn")


def replica_history(spark: SparkSession, root: str, keys: list[str], tracked: list[str]) -> DataFrame:
    """All versions of all rows after cdc_job()."""
    return changes.scd2_from_changes(spark.read.parquet(f"{root}/changes").drop("batch"), keys, tracked)


def alert_job(df: DataFrame, rules: dict[str, tuple[Column, int]], root: str, checkpoint: str, high: int = 70) -> None:
    """Scores a stream once and writes all rows to root/audit and those of the level `high` to root/alerts."""
    alerts, audit = st.table_sink(f"{root}/alerts"), st.table_sink(f"{root}/audit")
    both = st.fan_out(lambda b, n: alerts(b.where("level = 'high'"), n), audit)
    st.run_available(st.score(df, rules, high), both, checkpoint)


def recall(alerts: DataFrame, injected: DataFrame, key: str, pattern: str) -> DataFrame:
    """Of the injected cases of each pattern, how many have an alert."""
    hit = alerts.select(key).distinct().withColumn("_hit", F.lit(True))
    found = injected.join(hit, key, "left").groupBy(pattern).agg(F.count("*").alias("injected"), F.count("_hit").alias("found"))
    return found.withColumn("recall", F.round(F.col("found") / F.col("injected"), 6))


def lag_report(spark: SparkSession, progress: list[dict], now: str) -> DataFrame:
    """batch_id, topic, partition, read offset, latest offset and lag of each source partition, and the seconds
    from the latest event time to `now`. progress: recentProgress of one query."""
    rows = []
    for p in progress:
        newest = (p.get("eventTime") or {}).get("max")
        for s in p["sources"]:
            read, latest = (json.loads(x) if isinstance(x, str) else x or {} for x in (s.get("endOffset"), s.get("latestOffset")))
            rows += [(p["batchId"], topic, int(k), int(at), int((latest.get(topic) or {}).get(k, at)), newest) for topic, parts in read.items() for k, at in parts.items()]
    out = spark.createDataFrame(rows, "batch_id long, topic string, partition int, read long, latest long, newest string")
    behind = F.lit(now).cast("timestamp").cast("double") - F.col("newest").cast("timestamp").cast("double")
    return out.withColumn("lag", F.col("latest") - F.col("read")).withColumn("seconds_behind", behind).drop("newest")


def reconcile_day(streamed: DataFrame, whole: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """Totals of a stream's output and of the whole day beside each other, by day and keys; null where one has none."""
    by = [day, *keys]
    a = streamed.groupBy(*by).agg(F.count("*").alias("n_streamed"), F.round(F.sum(value), 4).alias("streamed"))
    b = whole.groupBy(*by).agg(F.count("*").alias("n_whole"), F.round(F.sum(value), 4).alias("whole"))
    return a.join(b, by, "full_outer").withColumn("agrees", F.col("n_streamed").eqNullSafe(F.col("n_whole")) & F.col("streamed").eqNullSafe(F.col("whole")))
