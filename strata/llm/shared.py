"""Small helpers of the operators in this package."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with texts of up to a few hundred kB, a batch stays well under an executor's memory.
BATCH_ROWS = 500

#: Bits of one of Spark's bitmaps (4 kB), and how many bitmaps sifted() sends to the tasks at most.
BITS, BITMAPS = 32_768, 1_024

#: Set where the session names no folder, as in tests on one machine.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="strata-")
    return _LOCAL["dir"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor loses nothing of it."""
    return cut_at(df, label)[0]


def cut_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same, and the table's path, for forget()."""
    path = f"{shared_dir(df.sparkSession)}/strata-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has the driver notice which frames are gone, so that Spark's cleaner deletes their shuffle files now and not at
    the next collection of garbage, which a driver with little to do may not see for half an hour. Spark holds on to the
    last query that it ran until it runs another one."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def utf8(texts) -> list[bytes]:
    """An Arrow column of strings as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def kept_columns(keep: tuple[str, ...], results: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to keep, without those that a result of the same name replaces."""
    return tuple(c for c in dict.fromkeys(keep) if c not in results)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sifted(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows whose columns named as those of keys may hold one of keys, and the rows that surely hold none. A join with keys
    then shuffles only the former with all that they hold. The hash of a key sets a bit; the bits, of which there are 64 a key and BITMAPS * BITS at
    most, go to all tasks, and the fuller they are, the more of the other rows are among the former."""
    on = [F.col(f.name).cast(f.dataType) for f in keys.schema]
    n = max(1, min(BITMAPS, -(-64 * keys.count() // BITS)))
    bit = F.pmod(F.xxhash64(F.lit("sifted"), *on), F.lit(n * BITS))
    set_ = keys.select(F.shiftright(bit, 15).alias("_map"), bit.bitwiseAND(BITS - 1).alias("_bit")).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = df.withColumns({"_map": F.shiftright(bit, 15), "_bit": bit.bitwiseAND(BITS - 1).cast("int")}).join(F.broadcast(set_), "_map", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("long")
    may = F.coalesce(F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1, F.lit(False))
    return rows.where(may).select(*df.columns), rows.where(~may).select(*df.columns)


def spread_sample(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About `most` of df's `rows` rows, chosen by a hash of key: the same ones on every run and retry."""
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_003)) < int(1_000_003 * most / rows))
