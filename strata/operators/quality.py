"""Data quality: checks that give rows, quarantine, gates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GateClosed(Exception):
    """A blocking check failed."""


def _report(table: str, check: str, failed: Column, total: Column) -> list[Column]:
    share = F.when(total == 0, 0.0).otherwise(100 * failed / total)
    return [F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.when(failed == 0, "pass").otherwise("fail").alias("status"), failed.alias("failed_count"), total.alias("total_count"), F.round(share, 4).alias("failed_pct")]


def qc_report(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule (a condition that a row violates), all from one pass. A null condition is no violation."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(F.when(c, 1)).alias(k) for k, c in rules.items()))
    rows = F.array(*(F.struct(*_report(table, k, F.col(k), F.col("_n"))) for k in rules))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNull() for c in columns}


def accepted(column: str, values: list, null_fails: bool = False) -> dict[str, Column]:
    bad = ~F.col(column).isin(values)
    return {f"{column}_accepted": bad | F.col(column).isNull() if null_fails else bad}


def in_range(column: str, low=None, high=None) -> dict[str, Column]:
    out = F.lit(False)
    out = out | (F.col(column) < low) if low is not None else out
    return {f"{column}_range": out | (F.col(column) > high) if high is not None else out}


def castable(column: str, kind: str) -> dict[str, Column]:
    return {f"{column}_as_{kind}": F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()}


def check_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """failed_count: rows beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("f"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    return n.select(*_report(table, f"{'_'.join(keys)}_unique", F.col("f"), F.col("t")))


def check_fk(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """failed_count: rows whose key isn't null and isn't in the parent."""
    known = parent.select(F.col(pk).alias("_pk")).distinct().withColumn("_known", F.lit(True))
    n = child.join(known, F.col(fk) == F.col("_pk"), "left").agg(F.count(F.when(F.col(fk).isNotNull() & F.col("_known").isNull(), 1)).alias("f"), F.count("*").alias("t"))
    return n.select(*_report(table, f"{fk}_fk", F.col("f"), F.col("t")))


def check_freshness(df: DataFrame, table: str, ts: str, now, hours: float) -> DataFrame:
    age = F.lit(now).cast("timestamp").cast("double") - F.max(F.col(ts).cast("timestamp").cast("double"))
    n = df.agg(F.when(age <= hours * 3600, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("f"), F.lit(1).cast("long").alias("t"))
    return n.select(*_report(table, f"{ts}_fresh", F.col("f"), F.col("t")))


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    from strata.sources.files import schema_diff

    return schema_diff(df.sparkSession, df.schema, expected)


def check_volume(history: DataFrame, table: str, n: int, tolerance: float) -> DataFrame:
    """n rows against the mean total_count of earlier runs."""
    mean = history.where(F.col("table_name") == table).agg(F.avg("total_count").alias("m"))
    bad = F.col("m").isNotNull() & (F.abs(F.lit(n) - F.col("m")) > tolerance * F.col("m"))
    return mean.select(*_report(table, "volume", F.when(bad, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.lit(1).cast("long")))


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls and their percentage, for all columns in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("nulls"), F.round(100 * (F.col("_n") - F.col(c)) / F.col("_n"), 4).alias("percent")) for c in df.columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and rejects with all reasons."""
    reasons = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def enforce(report: DataFrame, limits: dict[str, float], default: float = 0.0) -> list[str]:
    """Raises if a check fails for more per cent of rows than its limit; None as a limit only warns. Gives warnings."""
    failed = report.where("status = 'fail'").collect()  # a row for each check
    limit = lambda r: limits.get(r["check_name"], default)
    if blocking := [r["check_name"] for r in failed if limit(r) is not None and r["failed_pct"] > limit(r)]:
        raise GateClosed(", ".join(blocking))
    return [r["check_name"] for r in failed]


def quality_trend(history: DataFrame) -> DataFrame:
    """Failed checks of each day."""
    return history.groupBy(F.to_date("run_ts").alias("day"), "table_name").agg(F.count("*").alias("checks"), F.count(F.when(F.col("status") == "fail", 1)).alias("failed"))


def alerts(history: DataFrame) -> DataFrame:
    """Checks that fail in the latest run and didn't in the one before."""
    w = Window.partitionBy("table_name", "check_name").orderBy("run_ts")
    marked = history.withColumns({"_before": F.lag("status").over(w), "_next": F.lead("status").over(w)})
    return marked.where("status = 'fail' AND _next IS NULL AND coalesce(_before, 'pass') <> 'fail'").drop("_before", "_next")


def compare_outputs(a: DataFrame, b: DataFrame, sums: list[str]) -> DataFrame:
    """Counts, sums and a checksum of all rows of two outputs side by side."""
    figures = lambda df: [F.count("*").cast("double").alias("n_rows"), *(F.sum(c).cast("double").alias(c) for c in sums), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("double").alias("checksum")]
    one = [df.agg(*figures(df)).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ["n_rows", *sums, "checksum"])), F.array("n_rows", *sums, "checksum"))).alias("figure", side)) for df, side in ((a, "left"), (b, "right"))]
    return one[0].join(one[1], "figure").withColumn("same", F.col("left").eqNullSafe(F.col("right")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
