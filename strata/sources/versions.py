"""Versioned publishing on plain Parquet: a version is a folder, and exists once a row about it has been written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sources.files import safe_read

LOG = "version long, data string, published_at timestamp, n_rows long, note string"


class AuditFailed(Exception):
    """The checks of a publication failed."""


def _log(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return safe_read(spark, f"{root}/_versions", _parse_datatype_string(LOG))


def _record(spark: SparkSession, root: str, data: str, n: int, note: str) -> int:
    version = (_log(spark, root).agg(F.max("version")).collect()[0][0] or 0) + 1
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(data).alias("data"), F.current_timestamp().alias("published_at"), F.lit(n).cast("long").alias("n_rows"), F.lit(note).alias("note")).coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return version


def publish(df: DataFrame, root: str, note: str = "") -> int:
    """Writes df as a new version; readers see the old one or the whole new one. One writer at a time."""
    data = f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(data)
    return _record(df.sparkSession, root, data, df.sparkSession.read.parquet(data).count(), note)


def publish_if(df: DataFrame, root: str, *checks) -> int:
    """Writes df, audits what was written (each check gives the number of its failures) and only then publishes it."""
    spark, data = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(data)
    written = spark.read.parquet(data)
    if failed := {getattr(c, "__name__", str(k)): n for k, c in enumerate(checks) if (n := c(written))}:
        raise AuditFailed(str(failed))
    return _record(spark, root, data, written.count(), "audited")


def read_version(spark: SparkSession, root: str, version: int | None = None, as_of=None) -> DataFrame:
    """The latest version, one by number, or the one that held at a time."""
    log = _log(spark, root)
    if version is not None:
        log = log.where(F.col("version") == version)
    if as_of is not None:
        log = log.where(F.col("published_at") <= F.lit(as_of))
    row = log.orderBy(F.desc("version")).limit(1).collect()
    if not row:
        raise LookupError(f"no such version under {root}")
    return spark.read.parquet(row[0]["data"])


def history(spark: SparkSession, root: str) -> DataFrame:
    """Versions with their change in rows."""
    return _log(spark, root).withColumn("added_rows", F.col("n_rows") - F.lag("n_rows", 1, 0).over(Window.orderBy("version")))


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """Publishes an old version's data once more."""
    row = _log(spark, root).where(F.col("version") == version).collect()[0]
    return _record(spark, root, row["data"], row["n_rows"], f"rollback to {version}")


def expire(spark: SparkSession, root: str, older_than, retain_last: int = 1) -> int:
    """Deletes data that only versions older than a time use, but never that of the last few; says how many."""
    ranked = _log(spark, root).withColumn("age", F.row_number().over(Window.orderBy(F.desc("version"))))
    keep = (F.col("age") <= retain_last) | (F.col("published_at") >= F.lit(older_than))
    gone = ranked.groupBy("data").agg(F.max(keep).alias("kept")).where("NOT kept").collect()
    for r in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(r["data"])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def version_delta(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """new - old of each column, by key; a key that one side lacks counts as zero there."""
    a, b = (df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in columns)) for df, p in ((old, "old"), (new, "new")))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, *(x for c in columns for x in (f"old_{c}", f"new_{c}", (F.coalesce(f"new_{c}", F.lit(0)) - F.coalesce(f"old_{c}", F.lit(0))).alias(f"delta_{c}"))))
