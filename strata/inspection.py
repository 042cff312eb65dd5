"""Facts of plans and of event logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plan_text(df: DataFrame) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def plan_facts(df: DataFrame) -> dict:
    """What the planned scans push down and read, how many exchanges there are, and how joins are done."""
    text = plan_text(df)
    each = lambda label: re.findall(rf"^{label}: (.*)$", text, re.MULTILINE)
    nodes = re.findall(r"^\(\d+\) (\w+)", text, re.MULTILINE)
    return {
        "pushed_filters": each("PushedFilters"),
        "partition_filters": each("PartitionFilters"),
        "read_schema": each("ReadSchema"),
        "exchanges": sum(n == "Exchange" for n in nodes),
        "broadcasts": sum(n == "BroadcastExchange" for n in nodes),
        "joins": sorted(n for n in nodes if n.endswith("Join") or n in ("BroadcastNestedLoopJoin", "CartesianProduct")),
        "python": sorted({n for n in nodes if "Python" in n or "Pandas" in n or "InArrow" in n}),
    }


def scan_metrics(df: DataFrame) -> list[dict[str, int]]:
    """Files and bytes that each scan of a frame without exchanges chose, and the rows that it gave: the frame is run for it."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    leaves, out = run.executedPlan().collectLeaves(), []
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numFiles"):
            out.append({name: metrics.apply(key).value() for name, key in (("files", "numFiles"), ("bytes", "filesSize"), ("rows", "numOutputRows"))})
    return out


GROUPS = "file string, row_group int, n_rows long, n_bytes long, column_bytes long, nulls long"


def row_groups(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A row for each row group of a Parquet table, from the files' footers: rows, bytes of all columns and of this one (a leaf's path with dots), its
    nulls, and low and high, its bounds; null where the writer left none. Tasks read the footers, a few kB of each file."""
    df = spark.read.parquet(path)
    kind = df.select(F.col(column)).schema[0].dataType.simpleString()
    files = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string")  # the list that a scan plans with

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    chunk = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == column)
                    stats = chunk.statistics
                    bounds = (str(stats.min), str(stats.max)) if stats and stats.has_min_max else (None, None)
                    rows.append((name, g, group.num_rows, sum(group.column(k).total_compressed_size for k in range(group.num_columns)), chunk.total_compressed_size, stats.null_count if stats and stats.has_null_count else None, *bounds))
            names = ["file", "row_group", "n_rows", "n_bytes", "column_bytes", "nulls", "low", "high"]
            types = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    found = files.repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, GROUPS + ", low string, high string")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})


def hit(groups: DataFrame, low=None, high=None) -> DataFrame:
    """row_groups() that can hold a value from low to high, both inclusive; those without bounds always can."""
    can = F.lit(True)
    if low is not None:
        can = can & F.coalesce(F.col("high") >= F.lit(low), F.lit(True))
    if high is not None:
        can = can & F.coalesce(F.col("low") <= F.lit(high), F.lit(True))
    return groups.where(can)


_TASK = T.StructType([T.StructField("Launch Time", T.LongType()), T.StructField("Finish Time", T.LongType()), T.StructField("Failed", T.BooleanType())])
_METRICS = T.StructType([T.StructField("Memory Bytes Spilled", T.LongType()), T.StructField("Disk Bytes Spilled", T.LongType()), T.StructField("JVM GC Time", T.LongType())])
EVENT = T.StructType([
    T.StructField("Event", T.StringType()), T.StructField("Stage ID", T.LongType()), T.StructField("Task Info", _TASK), T.StructField("Task Metrics", _METRICS),
    T.StructField("Timestamp", T.LongType()), T.StructField("Executor ID", T.StringType()), T.StructField("Executor Info", T.StructType([T.StructField("Total Cores", T.LongType())])),
])


def event_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """Events of an uncompressed log (spark.eventLog.compress=false)."""
    return spark.read.schema(EVENT).json(log_dir)


def task_report(spark: SparkSession, log_dir: str) -> DataFrame:
    """Tasks of each stage: how many, the median and longest time, their ratio, spill and GC."""
    tasks = event_log(spark, log_dir).where("Event = 'SparkListenerTaskEnd'")
    ms = (F.col("Task Info.Finish Time") - F.col("Task Info.Launch Time")).alias("ms")
    rows = tasks.select(F.col("Stage ID").alias("stage_id"), ms, F.col("Task Metrics.Disk Bytes Spilled").alias("spilled"), F.col("Task Metrics.JVM GC Time").alias("gc"))
    out = rows.groupBy("stage_id").agg(F.count("*").alias("n_tasks"), F.percentile_approx("ms", 0.5).alias("median_ms"), F.max("ms").alias("max_ms"), F.coalesce(F.sum("spilled"), F.lit(0)).alias("spilled_bytes"), F.coalesce(F.sum("gc"), F.lit(0)).alias("gc_ms"))
    return out.withColumn("skew", F.round(F.col("max_ms") / F.greatest("median_ms", F.lit(1)), 2))


def core_hours(spark: SparkSession, log_dir: str, rate: float) -> DataFrame:
    """Hours of cores that each executor held, and their price. An executor that was not removed counts up to the
    log's last executor or application event."""
    log = event_log(spark, log_dir)
    added = log.where("Event = 'SparkListenerExecutorAdded'").groupBy(F.col("Executor ID").alias("executor")).agg(F.min("Timestamp").alias("start"), F.max("Executor Info.Total Cores").alias("cores"))
    removed = log.where("Event = 'SparkListenerExecutorRemoved'").groupBy(F.col("Executor ID").alias("executor")).agg(F.max("Timestamp").alias("stop"))
    last = log.agg(F.max("Timestamp").alias("_end"))  # one row
    hours = F.col("cores") * (F.coalesce("stop", "_end") - F.col("start")) / 3_600_000
    both = added.join(removed, "executor", "left").crossJoin(F.broadcast(last))
    return both.select("executor", "cores", F.round(hours, 6).alias("core_hours"), F.round(hours * rate, 6).alias("cost"))


def analyze(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """Statistics of a catalogued table, and of columns of it, for cost-based planning. They are a snapshot: a table that has changed
    since must be analyzed again."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    if columns:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")


STATISTICS = {"min": "low", "max": "high", "num_nulls": "n_nulls", "distinct_count": "n_distinct", "avg_col_len": "mean_length"}


def statistics(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """column, low, high (as text), n_nulls, n_distinct (estimated) and mean_length of analyzed columns; null where there are none."""
    rows = []
    for c in columns:
        said = {r["info_name"]: None if r["info_value"] == "NULL" else r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} {c}").collect()}
        rows.append((c, *(said.get(k) for k in STATISTICS)))
    texts = spark.createDataFrame(rows, "column string, " + ", ".join(f"{v} string" for v in STATISTICS.values()))
    return texts.withColumns({c: F.col(c).cast("long") for c in ("n_nulls", "n_distinct", "mean_length")})


def planned_by_cost(spark: SparkSession) -> SparkSession:
    """A session over the same catalog that orders joins by analyzed statistics; the caller's own stays as it is. A session
    keeps what it has read of a table: one that was made before the table was analyzed must refresh it."""
    other = spark.newSession()
    for k in ("cbo.enabled", "cbo.joinReorder.enabled", "cbo.planStats.enabled"):
        other.conf.set(f"spark.sql.{k}", "true")
    return other


def join_order(df: DataFrame) -> list[str]:
    """The tables of a plan's scans in the order in which they are joined, the first two of the innermost join first."""
    return [m.rsplit(".", 1)[-1] for m in re.findall(r"Relation (?:\w+\.)*(\w+)\[", df._jdf.queryExecution().optimizedPlan().toString())]
