"""Session profiles and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PROFILES = {
    "batch": {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "4m"},
    # the number of state partitions is fixed when a stream first starts
    "streaming": {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "64", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"},
    "test": {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
}
_LOCAL: dict[str, str] = {}


def session(profile: str = "batch", **conf: str) -> SparkSession:
    """A session with a profile's settings; conf goes on top."""
    builder = SparkSession.builder
    for k, v in (PROFILES[profile] | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="strata-"))


def tasks_for(df: DataFrame, rows: int = 500_000, least: int = 0) -> int:
    """How many tasks df is dealt over at so many rows each, at least one a core, or as given. Partitions that a shuffle is given by number are not merged at
    run time, so a task's share stays the same however large df is. df is counted, which reads footers alone if it is a scan."""
    return max(least or df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it is computed once, its lineage ends there, and a lost
    executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/strata-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
