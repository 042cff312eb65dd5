"""The corpus pipeline: documents in, packed sequences out. Each stage calls one operator of strata.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontamination, packing, pii, simhash, toxicity
from strata.llm.shared import cut, sifted, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.judge(docs, table(spark, sf_dir, "labels"), COLUMNS[1:]).where("NOT rejected").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    key = ["doc_id", "text_hash"]
    docs = docs.withColumn("text_hash", simhash.text_hash())
    copies = cut(simhash.near_duplicates(docs).where("NOT first").select(*key).distinct(), "copies")
    twice = docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    # only texts that may go are shuffled
    doubtful, sure = sifted(docs, cut(copies.union(twice), "doubtful"))
    return doubtful.join(copies, key, "left_anti").dropDuplicates([*key, "text"]).select(*COLUMNS).union(sure.select(*COLUMNS))


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"), COLUMNS[1:]).where("NOT contaminated").select(*COLUMNS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are generalised to their kind."""
    clean = pii.find(docs, COLUMNS[2:4]).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", keep_civil), ("near_dedup", keep_one_of_each), ("decontamination", keep_clean_of_benchmark), ("personal_data", sanitise), ("packing", pack)]

#: SQL has neither the models nor the tokenizer; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
