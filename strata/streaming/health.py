"""How a stream fares: a row for each batch from a listener, and rules over them."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "run string, name string, batch_id long, at timestamp, n_rows long, rows_per_second double, duration_ms long, state_rows long, removed_rows long, late_rows long, watermark timestamp, newest timestamp, offsets_behind long"


def progress_row(p: dict) -> tuple:
    """A query's progress (its JSON) as the values of PROGRESS."""
    state, event = p.get("stateOperators") or [], p.get("eventTime") or {}
    behind = [int(float((s.get("metrics") or {}).get("maxOffsetsBehindLatest") or 0)) for s in p.get("sources") or []]
    total = lambda k: sum(int(s.get(k) or 0) for s in state)
    return (p["runId"], p.get("name"), p["batchId"], p["timestamp"], int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0), int((p.get("durationMs") or {}).get("triggerExecution") or 0), total("numRowsTotal"), total("numRowsRemoved"), total("numRowsDroppedByWatermark"), event.get("watermark"), event.get("max"), max(behind, default=0))


class ProgressLog(StreamingQueryListener):
    """Gathers the progress of all queries of a session, and writes it as a table. Until it is written it is kept on the driver: a row
    for each batch, so write() belongs in the job's loop."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        row = progress_row(json.loads(event.progress.json))
        with self.lock:
            self.rows.append(row)

    def write(self, spark: SparkSession, path: str) -> int:
        """Appends what has come since the last time and says how many rows that is."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            schema = ", ".join(f"{c} string" if t == "timestamp" else f"{c} {t}" for c, t in (x.split() for x in PROGRESS.split(", ")))
            times = {c: F.col(c).cast("timestamp") for c in ("at", "watermark", "newest")}
            spark.createDataFrame(rows, schema).withColumns(times).coalesce(1).write.mode("append").parquet(path)
        return len(rows)


RULES = ("slow", "state_grows", "no_removals", "falls_behind")


def health(progress: DataFrame, trigger_ms: int, window: int = 5, behind_ms: int = 600_000, offsets: int = 100_000) -> DataFrame:
    """run, name, batch_id and a flag for each of RULES. slow: the batch took longer than the trigger. state_grows: the state has
    grown in each of the last `window` batches. no_removals: there is state, and none of it was removed in that many batches. falls_behind: more offsets are
    unread than `offsets`, or the newest event was older than behind_ms and the gap has grown over the window. A rule
    over a window says nothing until that many batches are there."""
    w = Window.partitionBy("run").orderBy("batch_id")  # the batches of one run
    last = w.rowsBetween(-(window - 1), 0)
    gap = F.unix_millis("at") - F.unix_millis("newest")
    rows = progress.withColumns({"_grew": F.coalesce(F.col("state_rows") > F.lag("state_rows").over(w), F.lit(False)).cast("int"), "_gap": gap})
    rows = rows.withColumns({"_n": F.count("*").over(last), "_grown": F.sum("_grew").over(last), "_removed": F.sum("removed_rows").over(last), "_gap_before": F.first("_gap").over(last)})
    full = F.col("_n") == window
    flags = {
        "slow": F.col("duration_ms") > trigger_ms,
        "state_grows": full & (F.col("_grown") == window),
        "no_removals": full & (F.col("state_rows") > 0) & (F.col("_removed") == 0),
        "falls_behind": (F.col("offsets_behind") > offsets) | (full & F.coalesce((F.col("_gap") > behind_ms) & (F.col("_gap") > F.col("_gap_before")), F.lit(False))),
    }
    return rows.select("run", "name", "batch_id", *(c.alias(k) for k, c in flags.items()))


def verdicts(flags: DataFrame) -> DataFrame:
    """run, name, rule, n_batches and fired (in how many of them) for each of RULES."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("on")) for k in RULES))).alias("x")
    return flags.select("run", "name", each).groupBy("run", "name", "x.rule").agg(F.count("*").alias("n_batches"), F.count(F.when(F.col("x.on"), 1)).alias("fired"))
