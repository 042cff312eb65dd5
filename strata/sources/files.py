"""Readers: frozen schemas, split of good and corrupt rows, lineage, inference only for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import cut

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """A CSV file, or a folder of parts with a header each. mode: PERMISSIVE, DROPMALFORMED or FAILFAST."""
    return spark.read.schema(schema).options(**{"header": True, "mode": mode, "columnNameOfCorruptRecord": CORRUPT} | options).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_parquet(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """merge_schema: columns that only some files have are null for the others; else one file's schema holds."""
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_partitioned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A partitioned tree with its columns in a fixed order, partition columns included."""
    return spark.read.option("basePath", path).parquet(path).select(*columns)


def safe_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a given schema; an empty or missing folder gives no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def raw_schema(columns: list[str]) -> T.StructType:
    """All columns as text, as a bronze table keeps them."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def with_lineage(df: DataFrame, run_id: str) -> DataFrame:
    """A scan's rows with their file, the time and the run. It belongs directly on the scan."""
    return df.withColumns({"_source_file": F.input_file_name(), "_ingested_at": F.current_timestamp(), "_run_id": F.lit(run_id)})


def read_split(spark: SparkSession, path: str, schema: T.StructType, run_id: str = "", **options) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows, corrupt rows with their text, and counts. The parsed rows are written once, since a filter on the
    corrupt column alone can't be answered by the reader."""
    rows = cut(with_lineage(read_csv(spark, path, with_corrupt(schema), **options), run_id), "parsed")
    n = rows.agg(F.count("*").alias("total"), F.count(CORRUPT).alias("corrupt")).collect()[0]
    good, bad = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull())
    return good, bad, {"total": n["total"], "corrupt": n["corrupt"], "good": n["total"] - n["corrupt"]}


def raw_line_count(spark: SparkSession, path: str) -> int:
    """Lines of the text, to reconcile with."""
    return spark.read.text(path).count()


def schema_diff(spark: SparkSession, inferred: T.StructType, frozen: T.StructType) -> DataFrame:
    """column, inferred, frozen and a verdict (missing, extra, type) for each column that differs."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (inferred, frozen))
    rows = [(c, a.get(c), b.get(c), "extra" if c not in b else "missing" if c not in a else "type") for c in dict.fromkeys([*b, *a]) if a.get(c) != b.get(c)]
    return spark.createDataFrame(rows, "column string, inferred string, frozen string, verdict string")


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, column: str | None = None, low=None, high=None, n: int = 1, **options) -> DataFrame:
    """A table in n ranges of a number or date column, or a query that the database runs. low and high shape the
    ranges only: the first takes nulls and all below, the last all above."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if query:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=n)
    return reader.load()


def quantile_bounds(spark: SparkSession, url: str, table: str, column: str, n: int, **options) -> list:
    """Values that part a table's rows into n ranges of about the same size; fewer if some are equal. Only the column is read, once."""
    keys = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT {column} FROM {table}) k", **options).load()
    found = keys.agg(F.percentile_approx(keys.columns[0], [k / n for k in range(1, n)], 10_000)).collect()[0][0] if n > 1 else None
    return sorted(set(found or []))


def range_predicates(column: str, bounds: list) -> list[str]:
    """Conditions that each row fulfils one of: nulls are in the first."""
    if not bounds:
        return ["1 = 1"]
    value = lambda b: str(b) if isinstance(b, int | float) else f"'{b}'"
    middle = [f"{column} >= {value(a)} AND {column} < {value(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{column} < {value(bounds[0])} OR {column} IS NULL", *middle, f"{column} >= {value(bounds[-1])}"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, n: int, bounds: list | None = None, **options) -> DataFrame:
    """A table in n ranges that hold about the same number of rows each, however the column is spread. bounds, if given, are taken
    as they are: whatever they are, each row is read once."""
    bounds = quantile_bounds(spark, url, table, column, n, **options) if bounds is None else sorted(set(bounds))
    return spark.read.jdbc(url, table, predicates=range_predicates(column, bounds), properties=options)
