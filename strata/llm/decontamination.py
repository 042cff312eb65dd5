"""Benchmark decontamination by spaced seeds.

A mask names the positions of a window that count; a hash over the words at those positions is the same in a test
item and in a document even if words at the other positions differ. Hits of the masks' hashes are verified: along the
diagonal of a hit, the overlap grows both ways while matches outweigh substitutions, and counts if it has enough
matching words.

The test items are taken in blocks of BLOCK_BYTES of text at most; the index of one block goes to all tasks, which
hold their documents against it, and a larger test set takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, kept_columns, small_batches, table

#: 1: the word counts; 0: it may differ.
MASKS = ("11111111", "111010010111", "110101101101", "101100111011")
#: Matching words that make an overlap count, or all words of an item with fewer; items of under SHORTEST are not looked for.
MATCHES, SHORTEST = 12, 8
SUBSTITUTION = -2
BLOCK_BYTES = 16_000_000
KNOWN_WORDS, FILTER_BITS = 500_000, 22
#: Hits that are looked up at once, about.
HITS = 1 << 20

_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return text.decode("utf-8", "replace").lower().encode().translate(_BREAKS).split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


def word_hashes(text: bytes, known: Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash of each window."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, MASKS.index(mask) + 1, dtype=np.uint64)
    for k, counts in enumerate(mask):
        if counts == "1":
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += h[k : k + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total


class Index:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        known = Hashes()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t, known) for _, t in items]
        found = [(seed_hashes(h, m), k) for k, h in enumerate(self.words) if len(h) >= SHORTEST for m in MASKS]
        hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, dtype=np.uint64)])
        item = np.concatenate([np.full(len(h), k, dtype=np.int64) for h, k in found] or [np.zeros(0, dtype=np.int64)])
        at = np.concatenate([np.arange(len(h), dtype=np.int64) for h, _ in found] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def diagonals(self, h: np.ndarray) -> np.ndarray:
        """Item and diagonal (place in the document less place in the item) of all hits, each once. Hits are looked up HITS at a time: a word that
        stands everywhere gives as many as there are pairs of its places, but few diagonals."""
        out = np.zeros(0, dtype=np.int64)  # both in one number
        for mask in MASKS:
            seeds = seed_hashes(h, mask)
            at = np.flatnonzero(self.filter[seeds >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(self.hashes, seeds[at], "left")
            count = np.searchsorted(self.hashes, seeds[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            part = np.cumsum(count) // HITS
            for k in np.unique(part):
                p, first, n = at[part == k], low[part == k], count[part == k]
                hit = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                out = np.unique(np.concatenate([out, (self.item[hit] << 40) + np.repeat(p, n) - self.at[hit] + (1 << 39)]))
        return np.column_stack([out >> 40, (out & ((1 << 40) - 1)) - (1 << 39)])

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Item, first word and end in the document, and matching words of each overlap that counts, by place."""
        found = []
        for item, d in self.diagonals(h).tolist():
            other = self.words[item]
            begin = max(0, d)
            same = h[begin : min(len(h), d + len(other))] == other[begin - d : min(len(other), len(h) - d)]
            hits = np.zeros(len(same), dtype=bool)
            for mask in MASKS:
                if (n := len(same) - len(mask) + 1) > 0:
                    hits[:n] |= np.logical_and.reduce([same[k : k + n] for k, counts in enumerate(mask) if counts == "1"])
            gain, reached = np.where(same, 1, SUBSTITUTION), 0
            for p in np.flatnonzero(hits).tolist():
                if p < reached:  # within an overlap, or one that failed
                    continue
                right, left = np.cumsum(gain[p:]), np.cumsum(gain[:p][::-1])
                reached = p + int(right.argmax()) + 1
                start = p - (int(left.argmax()) + 1 if len(left) and left.max() > 0 else 0)
                n = int(same[start:reached].sum())
                if n >= min(MATCHES, len(other)):
                    found.append((item, begin + start, begin + reached, n))
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull()).toLocalIterator():
        text = r["text"].encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Holds docs (doc_id, text) against benchmark (item_id, text); other columns are ignored.

    Returns a row for each row of docs: doc_id, the columns of docs named in `keep` (but for those of the names that are returned anyway),
    contaminated, items (ids of test items, sorted), and spans (item_id, start and end in words of the document, matched). Null and
    empty texts are clean, and null items and items of under SHORTEST words are not looked for; rows with an equal or null
    doc_id each get a row; an empty benchmark leaves all clean.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = kept_columns(keep, ("doc_id", "contaminated", "items", "spans"))
    kept = [F.struct(*(F.col(c) for c in keep)).alias("_kept")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    carried = [c for c in docs.columns if c != "text"]
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)
    kinds = "spans array<struct<item_id: long, start: long, end: long, matched: long>>"
    passes = []
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            from strata.llm.shared import utf8

            index, known, row = shared.value, Hashes(), TaskContext.get().partitionId() << 33
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "matched")]))
            for batch in batches:
                spans = [[(index.ids[i], a, b, n) for i, a, b, n in index.overlaps(word_hashes(t, known))] for t in utf8(batch.column(1))]
                rows = pa.array(range(row, row + len(spans)), pa.int64())
                row += len(spans)
                yield pa.RecordBatch.from_arrays([rows, *(batch.column(batch.schema.names.index(c)) for c in carried), pa.array([[dict(zip(("item_id", "start", "end", "matched"), s, strict=True)) for s in x] for x in spans], kind)], names=["_row", *carried, "spans"])

        passes.append(docs.mapInArrow(run, f"_row long{kept}, {kinds}"))
    if not passes:
        found = docs.select(*carried, F.lit(None).cast(kinds.removeprefix("spans ")).alias("spans")).withColumn("spans", F.coalesce("spans", F.filter("spans", lambda _: F.lit(False)), F.from_json(F.lit("[]"), kinds.removeprefix("spans "))))
    elif len(passes) == 1:
        found = passes[0]
    else:
        # each pass is a job by itself, so that a row has the same number in all
        every = cut(passes[0], "pass")
        for x in passes[1:]:
            every = every.unionByName(cut(x, "pass"))
        found = every.groupBy("_row").agg(*(F.first(c, ignorenulls=True).alias(c) for c in carried), F.flatten(F.collect_list("spans")).alias("spans"))
    return found.select("doc_id", *(F.col(f"_kept.{c}").alias(c) for c in keep), (F.size("spans") > 0).alias("contaminated"), F.array_sort(F.array_distinct("spans.item_id")).alias("items"), "spans")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items", F.size("spans").cast("long").alias("n_overlaps"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
