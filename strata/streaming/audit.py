"""What a stream must not lose or double: late rows kept beside it, and a ledger of its batches."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.files import safe_read
from strata.streaming import events as st

Sink = Callable[[DataFrame, int], None]

MARKS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_rows", "n_late", "mark_ms", "newest_ms")])
FIGURES = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("n_keys", T.LongType()), T.StructField("digest", T.DecimalType(38, 0))])


class ReplayDiffers(Exception):
    """A batch came again with other rows than the first time, so that its sink can't be trusted."""


def late_sink(root: str, column: str, delay: datetime.timedelta, accept: Sink) -> Sink:
    """Splits each batch by the watermark that holds for it: the newest event time of the batches before, less the delay.

    Rows up to the watermark, which a stateful operator of Spark's would drop without a word, go to root/late with the watermark
    that they missed; all others, those without an event time too, go to `accept`. root/marks has the figures of each batch. All three are
    written by batch number and follow from the batches before, so that a replay gives the same."""
    delay_ms = delay // datetime.timedelta(milliseconds=1)

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = safe_read(spark, f"{root}/marks/batch={n - 1}", MARKS).collect()  # one row
        newest = before[0]["newest_ms"] if before else None
        mark = None if newest is None else newest - delay_ms
        at = F.unix_micros(F.col(column).cast("timestamp"))
        late = F.lit(False) if mark is None else F.coalesce(at <= F.lit(mark * 1000), F.lit(False))
        batch = batch.persist()
        try:
            st.table_sink(f"{root}/late")(batch.where(late).withColumn("_missed", F.timestamp_millis(F.lit(mark).cast("long"))), n)
            accept(batch.where(~late), n)
            figures = batch.agg(F.count("*").alias("n_rows"), F.count(F.when(late, 1)).alias("n_late"), F.lit(mark).cast("long").alias("mark_ms"), F.greatest(F.floor(F.max(at) / 1000), F.lit(newest).cast("long")).alias("newest_ms"))
            st.table_sink(f"{root}/marks")(figures.coalesce(1), n)
        finally:
            batch.unpersist()

    return sink


def late_report(spark: SparkSession, root: str, column: str) -> DataFrame:
    """batch, n_rows, n_late, watermark and worst_ms (how far the latest of the late rows was behind it) of each batch."""
    worst = spark.read.parquet(f"{root}/late").groupBy("batch").agg(F.max(F.unix_millis("_missed") - F.unix_millis(F.col(column).cast("timestamp"))).alias("worst_ms"))
    return spark.read.parquet(f"{root}/marks").join(worst, "batch", "left").select("batch", "n_rows", "n_late", F.timestamp_millis("mark_ms").alias("watermark"), "worst_ms")


def figures(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_keys and a digest of all keys that doesn't depend on their order."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"), F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def ledger_sink(root: str, keys: list[str], sink: Sink) -> Sink:
    """Notes what is in a batch (root/intents) before `sink` gets it, and that it was written (root/done) afterwards.

    A batch that comes again must be what was noted; if its source gives other rows, ReplayDiffers is raised and nothing is written."""

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            now = figures(batch, keys).collect()[0]
            noted = safe_read(batch.sparkSession, f"{root}/intents/batch={n}", FIGURES).collect()
            if noted and tuple(noted[0]) != tuple(now):
                raise ReplayDiffers(f"batch {n}: {tuple(noted[0])} was noted, {tuple(now)} came")
            one = batch.sparkSession.createDataFrame([tuple(now)], FIGURES).coalesce(1)
            if not noted:
                st.table_sink(f"{root}/intents")(one, n)
            sink(batch, n)
            st.table_sink(f"{root}/done")(one, n)
        finally:
            batch.unpersist()

    return run


def exactly_once(spark: SparkSession, root: str, table: DataFrame, keys: list[str]) -> DataFrame:
    """One row: batches, unfinished (noted, not known to be written), noted rows, the table's rows and distinct keys, and whether
    each noted row is there once: as many rows, the same digest, no key twice."""
    intents, none = safe_read(spark, f"{root}/intents", T.StructType([*FIGURES, T.StructField("batch", T.IntegerType())])), T.StructType([*FIGURES, T.StructField("batch", T.IntegerType())])
    done = safe_read(spark, f"{root}/done", none).select("batch").distinct()
    noted = intents.join(done.withColumn("_done", F.lit(True)), "batch", "left").agg(F.count("*").alias("batches"), F.count(F.when(F.col("_done").isNull(), 1)).alias("unfinished"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("noted"), F.coalesce(F.sum("digest"), F.lit(0)).cast("decimal(38,0)").alias("_noted"))
    there = figures(table, keys).select(F.col("n_rows").alias("total"), F.col("n_keys").alias("distinct"), "digest")
    both = noted.crossJoin(there)  # one row each
    return both.withColumn("exactly_once", (F.col("noted") == F.col("total")) & (F.col("_noted") == F.col("digest")) & (F.col("total") == F.col("distinct"))).drop("_noted", "digest")
