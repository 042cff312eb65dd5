"""Damage to CSV lines by kind, and which check catches which kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import cut
from strata.sources import files

KINDS = ("missing_columns", "extra_column", "bad_type", "comma_in_text", "shifted_columns", "open_quote", "blank_line", "repeated_header")
RULES = ("typed_corrupt", "text_corrupt", "cast_loss", "domain", "header_row", "missing_row")
#: Stands before the key of a damaged line, so that it can be found again.
MARK = "dirty"


def chance(seed: int, key: Column) -> Column:
    """A number below 2^32 that follows from seed and key: the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def damaged(df: DataFrame, key: str, text: str, dates: list[str], per_mille: int, seed: int = 1) -> DataFrame:
    """line and kind (null: whole) of every row: CSV of df's columns, of which per_mille in a thousand are damaged, each in one of
    KINDS. key comes first and gets a mark in damaged lines; text is a column of words, dates are those that can lose their type."""
    others = [c for c in df.columns if c != key]
    draw = chance(seed, F.col(key))
    kind = F.when(draw % 1000 < per_mille, F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(draw / 1000) % len(KINDS) + 1).cast("int")))
    marked = F.concat_ws("-", F.lit(MARK), kind, F.col(key).cast("string"))
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda first, fields: F.concat_ws(",", first, *fields)
    plain = [field(c) for c in others]
    split = [F.concat(field(c), F.lit(", more")) if c == text else field(c) for c in others]
    forms = {
        "missing_columns": line(marked, plain[:-2]),
        "extra_column": line(marked, [*plain[:1], F.lit("STRAY"), *plain[1:]]),
        "bad_type": line(marked, [F.lit("yesterday") if c in dates else field(c) for c in others]),
        "comma_in_text": line(marked, split),
        "shifted_columns": line(marked, split[:-1]),
        "open_quote": F.concat(marked, F.lit(',"'), F.concat_ws(",", *plain)),
        "blank_line": F.lit(""),
        "repeated_header": F.lit(",".join([key, *others])),
    }
    whole, out = line(F.col(key).cast("string"), plain), None
    for name, form in forms.items():
        out = F.when(kind == name, form) if out is None else out.when(kind == name, form)
    return df.select(out.otherwise(whole).alias("line"), kind.alias("kind"))


def caught(spark: SparkSession, path: str, lines: DataFrame, schema: T.StructType, domains: dict[str, list]) -> DataFrame:
    """kind, injected, and for each of RULES how many lines of the kind it caught. lines, damaged()'s, were written to path as text.

    typed_corrupt: put aside by a reader with the types. text_corrupt: put aside by one that takes all as text. cast_loss: text that
    its type can't hold. domain: a value that the column may not have. header_row: a row of column names. missing_row: lines that no reader gave a row for."""
    key = schema.fields[0].name
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    mark = F.regexp_extract(F.col(key), rf"^{MARK}-([a-z_]+)-", 1)
    kind = F.when(mark != "", mark).when(F.col(key) == key, F.lit("repeated_header")).alias("kind")
    rows = {}
    for name, kinds in (("typed", T.StructType([text.fields[0], *schema.fields[1:]])), ("text", text)):
        # written with all columns: a reader that parses only those that are asked for doesn't see what is wrong in the others
        rows[name] = cut(spark.read.schema(files.with_corrupt(kinds)).options(mode="PERMISSIVE", columnNameOfCorruptRecord=files.CORRUPT).csv(path), name)
    corrupt = F.col(files.CORRUPT).isNotNull()
    loss = F.lit(False)
    for f in schema.fields[1:]:
        loss = loss | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    outside = F.lit(False)
    for c, values in domains.items():
        outside = outside | ~F.coalesce(F.col(c).isin(values), F.lit(True))
    count = lambda c: F.count(F.when(c, 1))
    typed = rows["typed"].groupBy(kind).agg(count(corrupt).alias("typed_corrupt"))
    texts = rows["text"].groupBy(kind).agg(F.count("*").alias("_rows"), count(corrupt).alias("text_corrupt"), count(~corrupt & loss).alias("cast_loss"), count(~corrupt & outside).alias("domain"), count(F.col(key) == key).alias("header_row"))
    injected = lines.groupBy("kind").agg(F.count("*").alias("injected"))
    same = lambda df: df.withColumnRenamed("kind", "_kind")
    out = injected.join(same(typed), F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind").join(same(texts), F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind").fillna(0, ["_rows", *RULES[:-1]])
    return out.withColumn("missing_row", F.col("injected") - F.col("_rows")).select("kind", "injected", *RULES)
