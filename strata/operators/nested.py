"""Nested data: JSON, arrays, structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_json(df: DataFrame, column: str, schema: T.StructType, to: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Rows whose text fits the schema, and the others, null texts among them."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    out = df.withColumn(to, F.from_json(column, full, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col(column).isNull() | F.col(f"{to}._corrupt_record").isNotNull()
    return out.where(~bad).withColumn(to, F.col(to).dropFields("_corrupt_record")), out.where(bad).drop(to)


def flatten_items(df: DataFrame, column: str, outer: bool = True) -> DataFrame:
    """A row for each struct of an array; outer keeps parents without any."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, (F.explode_outer if outer else F.explode)(column).alias("item")).select(*rest, "item.*")


def nest(df: DataFrame, keys: list[str], columns: list[str], to: str = "items") -> DataFrame:
    """Rows of a key as a sorted array of structs."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(to))


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every leaf of nested structs as a column parent_child."""

    def leaves(schema: T.StructType, path: str = "") -> list[Column]:
        out = []
        for f in schema.fields:
            at = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            out += leaves(f.dataType, at) if isinstance(f.dataType, T.StructType) else [F.col(at).alias(at.replace("`", "").replace(".", sep))]
        return out

    return df.select(*leaves(df.schema))


def word_count(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(F.lower(column), r"\s+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def array_total(items: Column, price: str = "price", qty: str = "qty") -> Column:
    """Sum of price times quantity, without leaving the row."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x[price] * x[qty], F.lit(0.0)))
