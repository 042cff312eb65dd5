"""Removal of passages that stand in an earlier document, by a log-structured index of window hashes.

A window is WINDOW consecutive words. The index keeps the hash of every distinct window and the smallest doc_id that has
it, in runs: Parquet tables, each sorted by hash within ranges of hashes (buckets), written once for each batch of
documents and never changed. A new batch's windows are merge-joined with all runs, bucket by bucket: this tells which of
its windows stand in a document with a smaller doc_id, and gives the batch's own run. When there would be FANOUT runs,
the same pass merges them all into one (compaction).

Equal hashes are then verified: the passages of the earlier documents, and of these alone, are read again and sent to
where they are needed, and a window is removed if all its words are the same there. Windows that meet within a task
are compared by their words at once. No text of the history is read to judge a batch.

Rows that Spark shuffles hold the numbers of many windows each, so that a window costs about eight bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, forget, release, shared_dir, small_batches, table

WINDOW = 13
#: Runs that are merged into one, and the batches of the query (more than FANOUT, so that it merges).
FANOUT, BATCHES = 4, 5
#: Ranges of buckets that are merged one after another.
PARTS = 2
#: Windows that a task holds before it hands them on, and that a bucket of the whole corpus should hold.
HELD_WINDOWS, BUCKET_WINDOWS = 500_000, 500_000
#: Bytes of text that meet in one group when passages are removed.
SHARD_BYTES = 8_000_000
KNOWN_WORDS = 500_000
#: Rows of fewer bytes are not compressed.
COMPRESSED_BYTES = 4096
#: Ids of matched documents that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

RUN, HIT, SURE, NEED = "run", "hit", "sure", "need"
#: part: a bucket, or the shard of the documents that ids, or sources, name. hit and sure: a window of document id stands
#: in a smaller one, by its hash or by its words. need: shard `target` needs that window of document id.
ROWS = "kind string, part long, ids binary, hashes binary, targets binary"


class Lexicon(dict):
    """Numbers for words, in the order in which they are met, and their hashes."""

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of these texts in turn, and how many each text has."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum())), lengths


def _rolled(h: np.ndarray, words: int, by: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A hash of each run of so many words, put together from runs of 1, 2, 4, ... words."""
    total, have, power, step = None, 0, h, 1
    by = np.uint64(by)
    with np.errstate(over="ignore"):
        while True:
            if words & step:
                total = power if total is None else total[: len(h) - have - step + 1] * by**step + power[have : len(h) - step + 1]
                have += step
            if have == words:
                break
            power = power[:-step] * by**step + power[step:]
            step *= 2
        total = total[: len(h) - words + 1].copy()
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(32))


def windows(words: np.ndarray, lengths: np.ndarray, lexicon: Lexicon, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of texts that follow one another: the number of its text, its first word and its hash."""
    n = np.maximum(lengths - window + 1, 0)
    text = np.repeat(np.arange(len(lengths)), n)
    start = np.arange(n.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n)
    if not len(start):
        return text, start, np.zeros(0, dtype=np.uint64)
    return text, start, _rolled(np.frombuffer(lexicon.hashes, dtype=np.uint64)[words], window)[start]


def same_words(words: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that begin at a in words and at b in other have the same words."""
    same = np.ones(len(a), dtype=bool)
    for k in range(window):
        same &= words[a + k] == other[b + k]
    return same


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, the lowest byte of all first, then the next: what is equal or zero compresses so. Where
    there are many they are compressed; the first four bytes tell (0: they are not)."""
    import pyarrow as pa

    raw = x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if len(raw) >= COMPRESSED_BYTES else b"\0\0\0\0" + raw


def unpacked(rows) -> np.ndarray:
    """The numbers of several packed rows."""
    import pyarrow as pa

    parts = []
    for x in rows:
        size, x = int.from_bytes(x[:4], "little"), memoryview(x)[4:]
        raw = pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True) if size else x
        parts.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def deltas(h: np.ndarray) -> bytes:
    """Sorted hashes, by their differences."""
    return packed(np.diff(h, prepend=np.uint64(0)).view(np.int64))


def undeltas(rows) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [np.cumsum(unpacked([x]).view(np.uint64), dtype=np.uint64) for x in rows]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, in order."""
    return ((h >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return (ids ^ (ids >> 17) ^ (ids >> 31)) % shards


def shard_column(shards: int) -> Column:
    """shard_of() for the column doc_id; rows without an id are dealt by their text."""
    i = F.col("doc_id")
    return F.pmod(F.coalesce(i.bitwiseXOR(F.shiftright(i, 17)).bitwiseXOR(F.shiftright(i, 31)), F.xxhash64("text")), F.lit(shards))


def _rows(found: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*found, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "part", "ids", "hashes", "targets"])


def by_part(kind: str, part: np.ndarray, ids: np.ndarray, hashes: np.ndarray, targets: np.ndarray | None = None) -> list[tuple]:
    """Rows of ROWS, one for each part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part, ids, hashes = part[order], ids[order], hashes[order]
    targets = targets[order] if targets is not None else None
    firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
    return [(kind, int(part[i]), packed(ids[i:j]), packed(hashes[i:j].view(np.int64)), packed(targets[i:j]) if targets is not None else None) for i, j in zip(firsts, [*firsts[1:], len(part)], strict=True)]


def entries(docs: DataFrame, buckets: int, shards: int, window: int) -> DataFrame:
    """ROWS of a batch: for its buckets (run) each distinct window of what a task holds at once with the smallest doc_id
    there, and (sure) the windows of the other documents, compared by their words."""

    def run(batches: Iterator) -> Iterator:
        from strata.llm.shared import utf8

        lexicon, held, n = Lexicon(), [], 0

        def out() -> list[tuple]:
            held.sort(key=lambda x: x[0])
            ids = np.array([i for i, _ in held], dtype=np.int64)
            words, lengths = lexicon.numbers([w for _, w in held])
            text, start, h = windows(words, lengths, lexicon, window)
            order = np.argsort(h, kind="stable")
            h, start, doc = h[order], start[order], ids[text[order]]
            new = np.r_[True, h[1:] != h[:-1]]
            firsts, group = np.flatnonzero(new), np.cumsum(new) - 1
            later = np.flatnonzero(doc > doc[firsts][group])
            same = same_words(words, start[later], words, start[firsts][group[later]], window)
            sure, odd = later[same], later[~same]
            h_out, doc_out = h[firsts], doc[firsts]
            if len(odd):  # other words under the same hash
                h_out, doc_out = np.r_[h_out, h[odd]], np.r_[doc_out, doc[odd]]
                at = np.argsort(h_out, kind="stable")
                h_out, doc_out = h_out[at], doc_out[at]
            edges = np.searchsorted(bucket_of(h_out, buckets), np.arange(buckets + 1))
            found = [(RUN, k, packed(doc_out[i:j]), deltas(h_out[i:j]), None) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
            return found + by_part(SURE, shard_of(doc[sure], shards), doc[sure], h[sure])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.split()
                if len(words) >= window:
                    held.append((i, words))
                    n += len(words)
                if n >= HELD_WINDOWS:
                    yield _rows(out())
                    held, n = [], 0
                    if len(lexicon) > KNOWN_WORDS:
                        lexicon = Lexicon()
        if held:
            yield _rows(out())

    return _texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, ROWS)


def merged(batch: DataFrame, history: DataFrame | None, shards: int, compact: bool) -> DataFrame:
    """Merge-joins a batch's entries with the runs: ROWS with the new run (with all old ones merged into it, if compact),
    hits and needs."""

    def merge(t):
        import pyarrow as pa

        kind = t.column("kind").to_pylist()
        take = lambda k: t.filter(pa.array([x == k for x in kind], pa.bool_()))
        new, old, out, part = take(RUN), take("old"), [], t.column("part")[0].as_py()
        h, doc = np.concatenate([np.zeros(0, dtype=np.uint64), *undeltas(new.column("hashes").to_pylist())]), unpacked(new.column("ids").to_pylist())
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        begins = np.r_[True, h[1:] != h[:-1]][: len(h)]
        firsts, group = np.flatnonzero(begins), np.cumsum(begins) - 1
        own, least = h[firsts], np.minimum.reduceat(doc, firsts) if len(h) else doc
        first = least.copy()
        runs = [(x, unpacked([d])) for x, d in zip(undeltas(old.column("hashes").to_pylist()), old.column("ids").to_pylist(), strict=True)]
        for x, d in runs:
            at = np.minimum(np.searchsorted(x, own), len(x) - 1)
            met = x[at] == own
            first[met] = np.minimum(first[met], d[at[met]])
        hit = np.flatnonzero(doc > first[group]) if len(h) else np.zeros(0, dtype=np.int64)
        a, source, seen = doc[hit], first[group[hit]] if len(hit) else doc[hit], h[hit]
        out += by_part(HIT, shard_of(a, shards), a, seen)
        if len(hit):
            target = shard_of(a, shards)
            order = np.lexsort((target, seen))
            once = order[np.r_[True, (seen[order][1:] != seen[order][:-1]) | (target[order][1:] != target[order][:-1])]]
            out += by_part(NEED, shard_of(source[once], shards), source[once], seen[once], target[once])
        if compact and runs:
            own, least = np.concatenate([own, *(x for x, _ in runs)]), np.concatenate([least, *(d for _, d in runs)])
            order = np.argsort(own, kind="stable")  # sorted pieces
            own, least = own[order], least[order]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            own, least = own[firsts], np.minimum.reduceat(least, firsts)
        if len(own):
            out.append((RUN, part, packed(least), deltas(own), None))
        return pa.Table.from_batches([_rows(out)])

    rows = batch if history is None else batch.unionByName(history.withColumn("kind", F.lit("old")))
    return rows.groupBy("part").applyInArrow(merge, ROWS)


class WindowIndex:
    """Runs under a folder, each in PARTS tables. buckets: ranges of hashes, of some 500,000 windows of all that the index
    will hold."""

    def __init__(self, spark: SparkSession, buckets: int = 64, window: int = WINDOW, path: str | None = None, runs: list[list[str]] | None = None):
        self.spark, self.buckets, self.window = spark, buckets, window
        self.path, self.runs = path or f"{shared_dir(spark)}/strata-windows-{uuid.uuid4().hex}", list(runs or [])

    def _read(self, paths: list[str], low: int, high: int) -> DataFrame | None:
        parts = [self.spark.read.schema(ROWS).parquet(p).where((F.col("kind") == RUN) & (F.col("part") >= low) & (F.col("part") < high)) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def add(self, batch: DataFrame, shards: int) -> DataFrame:
        """Judges a batch (doc_id, text) by itself and by the runs, and adds its own run, or merges all: then the old ones
        go once the new one is whole. Returns ROWS of hit, sure and need. One of PARTS ranges of buckets after another
        is merged, so that no more than that share of the history is in a shuffle at a time."""
        small_batches(self.spark)
        old, compact = self.runs, len(self.runs) + 1 >= FANOUT
        to = f"{self.path}/run-{uuid.uuid4().hex}"
        entries(batch, self.buckets, shards, self.window).write.partitionBy("kind").parquet(f"{to}/entries")
        new, ends = [], [self.buckets * k // PARTS for k in range(PARTS + 1)]
        for low, high in zip(ends, ends[1:], strict=False):
            out = merged(self._read([f"{to}/entries"], low, high), self._read([p for run in old for p in run], low, high), shards, compact)
            new.append(f"{to}/{low}")
            out.write.partitionBy("kind").option("compression", "zstd").parquet(new[-1])
            del out
            release(self.spark)
        self.runs = [new] if compact else [*old, new]
        forget(self.spark, f"{to}/entries/kind={RUN}")
        if compact:
            self.forget(old)
        hits = [self.spark.read.schema(ROWS).parquet(p).where(F.col("kind") != RUN) for p in [f"{to}/entries", *new]]
        return reduce(DataFrame.unionByName, hits)

    def forget(self, runs: list[list[str]]) -> None:
        """Deletes the runs; the hits that were found with them stay."""
        for p in (p for run in runs for p in run):
            forget(self.spark, f"{p}/kind={RUN}")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def passages(docs: DataFrame, hits: DataFrame, shards: int, window: int) -> DataFrame:
    """part and words: for each shard, the passages (words joined by a space) of the needed windows of the documents."""

    def cut_out(docs, needs):
        import pyarrow as pa

        from strata.llm.shared import utf8

        part, found = [], []
        ids, hashes, targets = (unpacked(needs.column(c).to_pylist()) for c in ("ids", "hashes", "targets"))
        order = np.argsort(ids, kind="stable")
        ids, hashes, targets = ids[order], hashes[order], targets[order]
        lexicon = Lexicon()
        for i, text in zip(docs.column("doc_id").to_pylist(), utf8(docs.column("text")), strict=True):
            if i is None:
                continue
            low, high = np.searchsorted(ids, [i, i + 1]) if i < 2**63 - 1 else (np.searchsorted(ids, i), len(ids))
            if low == high:
                continue
            words = text.split()
            numbers, lengths = lexicon.numbers([words])
            _, start, h = windows(numbers, lengths, lexicon, window)
            h = h.view(np.int64)
            for target in np.unique(targets[low:high]).tolist():
                at = start[np.isin(h, hashes[low:high][targets[low:high] == target])]
                ends = np.flatnonzero(np.r_[at[1:] > at[:-1] + 1, True][: len(at)])  # windows that follow one another are one passage
                for x, y in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=False):
                    part.append(target)
                    found.append(b" ".join(words[at[x] : at[y] + window]))
        return pa.table({"part": pa.array(part, pa.int64()), "words": pa.array(found, pa.binary())})

    def named(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # a document is named in many rows; a task names it once for some million times
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["doc_id"])
        held, n = [np.zeros(0, dtype=np.int64)], 0
        for batch in batches:
            held.append(np.unique(unpacked(batch.column(0).to_pylist())))
            n += len(held[-1])
            if n > BROADCAST_IDS:
                held = [np.unique(np.concatenate(held))]
                n = len(held[0])
                if n > BROADCAST_IDS // 2:
                    yield out()
                    held, n = [held[0][:0]], 0
        yield out()

    need = hits.where(F.col("kind") == NEED)
    matched = cut(need.select("ids").mapInArrow(named, "doc_id long").distinct(), "matched")
    # at most BROADCAST_IDS numbers go to all tasks; more meet the documents in a shuffle
    few = F.broadcast(matched) if matched.count() <= BROADCAST_IDS else matched
    texts = _texts(docs).join(few, "doc_id", "left_semi")
    return texts.groupBy(shard_column(shards)).cogroup(need.groupBy("part")).applyInArrow(cut_out, "part long, words binary")


def kept_words(docs: DataFrame, hits: DataFrame, found: DataFrame, shards: int, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """docs without the words under windows that are sure, or hits whose words stand in the passages found."""
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def remove(docs, rows):
        import pyarrow as pa

        from strata.llm.shared import utf8

        kind = rows.column("kind").to_pylist()
        take = lambda k, c: [x for x, y in zip(rows.column(c).to_pylist(), kind, strict=True) if y == k]
        marks = {}
        for k in (HIT, SURE):
            ids, hashes = unpacked(take(k, "ids")), unpacked(take(k, "hashes"))
            order = np.argsort(ids, kind="stable")
            marks[k] = ids[order], hashes[order].view(np.uint64)
        lexicon = Lexicon()
        passage, lengths = lexicon.numbers([x.split(b" ") for x in take("passage", "ids")])
        _, at, known = windows(passage, lengths, lexicon, window)
        known, first = np.unique(known, return_index=True)
        at = at[first]
        out: list[list] = [[], [], [], []]
        for i, text in zip(docs.column("doc_id").to_pylist(), utf8(docs.column("text")), strict=True):
            left = words = text.split()
            own = {k: hashes[slice(*np.searchsorted(ids, [i, i]).tolist()[:1], int(np.searchsorted(ids, i, "right")))] for k, (ids, hashes) in marks.items()} if i is not None else {}
            if any(map(len, own.values())):
                numbers, n = lexicon.numbers([words])
                _, start, h = windows(numbers, n, lexicon, window)
                gone = np.isin(h, own[SURE])
                maybe = np.flatnonzero(np.isin(h, own[HIT]) & ~gone)
                if len(maybe) and len(known):
                    to = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                    maybe, to = maybe[known[to] == h[maybe]], to[known[to] == h[maybe]]
                    gone[maybe[same_words(numbers, start[maybe], passage, at[to], window)]] = True
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                covered[np.flatnonzero(gone)] += 1
                covered[np.flatnonzero(gone) + window] -= 1
                left = [words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
            joined = b" ".join(left)
            for column, x in zip(out, (len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined), strict=True):
                column.append(x)
        columns = {"doc_id": docs.column("doc_id"), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": pa.array(out[2], pa.string())}
        return pa.table(columns | ({"kept": pa.array(out[3], pa.binary()).cast(pa.string())} if with_text else {}))

    marks = hits.where(F.col("kind").isin(HIT, SURE)).select("kind", "part", "ids", "hashes")
    marks = marks.unionByName(found.select(F.lit("passage").alias("kind"), "part", F.col("words").alias("ids"), F.lit(None).cast("binary").alias("hashes")))
    return _texts(docs).groupBy(shard_column(shards)).cogroup(marks.groupBy("part")).applyInArrow(remove, kinds)


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Buckets and shards for all documents that an index will hold."""
    n = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).collect()[0][0]
    # six bytes a word, about. An odd number of shards, so that ids in even steps are spread
    return min(max(8, math.ceil(n / 6 / BUCKET_WINDOWS)), 1 << 18), max(9, math.ceil(n / SHARD_BYTES) | 1)


def dedup_batch(batch: DataFrame, index: WindowIndex, history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Removes from a batch of documents (doc_id, text; other columns are ignored) the words of windows that also
    start in a document with a smaller doc_id, of the batch or of `history`, the documents whose windows the index
    has. Adds the batch to the index.

    Returns a row for each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and
    with_text these words as `kept`. Windows are judged as they stand in the input. A null or empty text has no words;
    rows with equal doc_id have no smaller one among them; a row without doc_id is kept whole and removes nothing; an
    empty batch gives an empty result. Different windows of one hash (one pair in 2 ** 64) never remove each other; beside
    one, a third window may stay.
    """
    shards = sizes(batch)[1]
    hits = index.add(batch, shards)
    every = _texts(batch) if history is None else _texts(history).unionByName(_texts(batch))
    return kept_words(batch, hits, cut(passages(every, hits, shards, index.window), "passages"), shards, index.window, with_text)


def dedup(docs: DataFrame, shares: tuple[float, ...] = (1 / BATCHES,) * BATCHES, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The same over documents in batches by ranges of doc_id, each of a share of the range, that come to an index one
    after another. What they have to verify is read at the end, once for all."""
    buckets, shards = sizes(docs)
    index = WindowIndex(docs.sparkSession, buckets, window)
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).collect()[0]
    if low is None:
        return kept_words(docs, index.add(docs, shards), docs.sparkSession.createDataFrame([], "part long, words binary"), shards, window, with_text)
    hits, doc = None, F.col("doc_id").cast("long")
    ends = [low + int((high - low + 1) * sum(shares[:k])) for k in range(len(shares))] + [high + 1]
    for a, b in zip(ends, ends[1:], strict=False):
        part = index.add(docs.where((doc >= a) & (doc < b)), shards)
        hits = part if hits is None else hits.unionByName(part)
    index.forget(index.runs)
    return kept_words(docs, hits, cut(passages(docs, hits, shards, window), "passages"), shards, window, with_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
