"""Packing of tokenised documents into sequences of bounded length: dominance reduction, then best fit.

Lengths are whole numbers from 1 to the capacity, so the whole instance is its histogram, whose size does not depend
on the number of documents. The driver decides on the histogram: it first fixes the small sets of lengths that
dominate every other set holding their largest member (Martello and Toth's reduction), which takes nothing away from
some optimal packing, and packs what is left best-fit, longest first. Its decisions are runs: so many pieces of one
length, by rank, go to so many consecutive sequences. Spark ranks the pieces of each length and looks up their runs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.shared import cut, small_batches, table

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a task remembers, and the longest of them.
CACHE_WORDS, CACHE_WORD_BYTES = 1_200_000, 64

#: length, first rank, number of pieces, first sequence, pieces a sequence takes, offset of the first of them
Run = tuple[int, int, int, int, int, int]


class _Stock:
    """What is left of the histogram; pieces of a length are taken in the order of their ranks."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)

    def take(self, length: int, n: int) -> int:
        rank = self.taken[length]
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))
        return rank

    def at_most(self, room: int, besides: int = 0) -> int:
        """The largest length left of `room` at most, with one piece of length `besides` put aside; 0: none."""
        i = bisect.bisect_right(self.lengths, room) - 1
        while i >= 0 and self.left[self.lengths[i]] <= (self.lengths[i] == besides):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def smallest(self, n: int, besides: int) -> list[int]:
        """The n smallest pieces left, with one of length `besides` put aside."""
        found: list[int] = []
        for x in self.lengths:
            found += [x] * min(n - len(found), self.left[x] - (x == besides))
            if len(found) == n:
                break
        return found


def reduce_by_dominance(stock: _Stock, capacity: int) -> tuple[list[Run], int]:
    """Fixes the sets that dominate: a full piece alone; two pieces that fill a sequence; the longest piece alone if
    nothing fits beside it, with the longest that fits if no two do, and with it too if that is no shorter than the
    longest two that fit together when no three do. Returns the runs and the number of sequences."""
    runs: list[Run] = []
    bins = 0

    def fix(a: int, b: int, n: int) -> None:
        nonlocal bins
        runs.append((a, stock.take(a, n), n, bins, 1, 0))
        if b:
            runs.append((b, stock.take(b, n), n, bins, 1, a))
        bins += n

    for x in [x for x in stock.lengths if 2 * x >= capacity][::-1]:
        n, y = stock.left[x], capacity - x
        if not y:
            fix(x, 0, n)
        elif x == y and n > 1:
            runs.append((x, stock.take(x, n // 2 * 2), n // 2 * 2, bins, 2, 0))
            bins += n // 2
        elif x != y and y in stock.left:
            fix(x, y, min(n, stock.left[y]))
    for x in stock.lengths[::-1]:
        while stock.left.get(x):
            room, least = capacity - x, stock.smallest(3, x)
            n = stock.left[x]
            y = stock.at_most(room, x)
            if not y:
                fix(x, 0, n)
            elif len(least) < 2 or least[0] + least[1] > room:
                if x == y:
                    m = n // 2 * 2
                    runs.append((x, stock.take(x, m), m, bins, 2, 0))
                    bins += m // 2
                else:
                    fix(x, y, min(n, stock.left[y]))
            elif (len(least) < 3 or sum(least) > room) and y >= _best_pair(stock, room, x):
                fix(x, y, 1) if x != y else fix_pair(runs, stock, x, bins)
                bins += x == y
            else:
                break
    return runs, bins


def fix_pair(runs: list[Run], stock: _Stock, x: int, at: int) -> None:
    runs.append((x, stock.take(x, 2), 2, at, 2, 0))


def _best_pair(stock: _Stock, room: int, besides: int) -> int:
    """The largest sum of two pieces left within room, with one of length `besides` put aside."""
    free = [(x, n) for x in stock.lengths[: bisect.bisect_right(stock.lengths, room)] if (n := stock.left[x] - (x == besides))]
    best, low, high = 0, 0, len(free) - 1
    while low <= high:
        both = free[low][0] + free[high][0]
        if both > room:
            high -= 1
        else:
            if low < high or free[low][1] > 1:
                best = max(best, both)
            low += 1
    return best


def best_fit(stock: _Stock, capacity: int, bins: int) -> tuple[list[Run], int]:
    """Longest first, each piece into the fullest sequence that has room. Sequences of equal room whose numbers follow
    one another are one group, so equal pieces are placed together."""
    runs: list[Run] = []
    rooms: list[tuple[int, int, int]] = []  # room, first sequence, number of sequences; sorted
    for x in stock.lengths[::-1]:
        while n := stock.left.get(x, 0):
            i = bisect.bisect_left(rooms, (x, -1, -1))
            if i == len(rooms):
                new = -(-n // (capacity // x))
                rooms.append((capacity, bins, new))
                bins += new
            room, first, count = rooms.pop(i)
            each = room // x
            full = min(count, n // each)
            if full:
                runs.append((x, stock.take(x, full * each), full * each, first, each, capacity - room))
                bisect.insort(rooms, (room - each * x, first, full)) if room > each * x else None
                first, count, n = first + full, count - full, n - full * each
            if count and 0 < n < each:
                runs.append((x, stock.take(x, n), n, first, each, capacity - room))
                bisect.insort(rooms, (room - n * x, first, 1)) if room > n * x else None
                first, count = first + 1, count - 1
            if count:
                bisect.insort(rooms, (room, first, count))
    return runs, bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs for a histogram {length: pieces}, and the number of sequences."""
    stock = _Stock(histogram)
    fixed, bins = reduce_by_dominance(stock, capacity)
    rest, bins = best_fit(stock, capacity, bins)
    return fixed + rest, bins


class Words:
    """Ids of texts, by word: the tokenizer cuts at white space first, so a text's ids are those of its words in turn.
    ids hold two bytes each while the vocabulary allows it."""

    #: Stands between words that are encoded as one text. Its id spells this byte, so no word without it has the id;
    #: words with it, or with a character that may begin a special token, are encoded each by itself.
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        alone = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark_id = alone[0] if len(alone) == 1 else -1
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, in turn."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            if self.mark_id < 0 or any(b"<" in w or b"\x01" in w for w in part):
                found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                yield from (np.array(e.ids, dtype=self.kind).tobytes() for e in found)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".encode().join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = [*(np.flatnonzero(ids == self.mark_id) * self.kind.itemsize).tolist(), len(ids) * self.kind.itemsize]
            data, start = ids.tobytes(), 0
            for end in ends:
                yield data[start:end]
                start = end + self.kind.itemsize

    def learn(self, texts: list[list[bytes]]):
        """A function from each word of these texts to its ids."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = set().union(*texts)
        odd = [w for w in new if len(w) > CACHE_WORD_BYTES or b"<" in w or b"\x01" in w]
        plain = list(new.difference(odd))
        self.known.update(zip(plain, self.encode(plain), strict=True))
        if not odd:
            return self.known.__getitem__
        known, extra = self.known, dict(zip(odd, self.encode(odd), strict=True))
        return lambda w: known[w] if w in known else extra[w]


#: Of this process, by path: tasks that follow one another in a Python worker share it.
_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and the task that made it with the
    piece's rank among that task's pieces of its length; with_ids: the ids too. A null or empty text is the end id."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from strata.llm.packing import words_of
        from strata.llm.shared import utf8

        words, task, seen = words_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_ID], dtype=words.kind).tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            texts = [text.split() for text in utf8(batch.column(1))]
            ids_of = words.learn(texts)
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.frombuffer(b"".join(map(ids_of, text)) + end, dtype=words.kind).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    seen[len(part)] += 1
                    for column, x in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)]) - 1, part), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in list(zip(rows, kinds, strict=True))[: 8 if with_ids else 7]], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: 8 if with_ids else 7])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text; other columns are ignored) into as few sequences as it can.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the
    ids. Only documents longer than capacity are cut. A null or empty text is one piece of one token; rows with
    equal, or with null, doc_id are packed each on its own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = cut(tokenised(docs, tokenizer, capacity, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # the histogram has at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "task")
    order = sorted(runs)
    keys = np.array([(r[0], r[1]) for r in order], dtype=np.int64).reshape(-1, 2)
    first_of = np.searchsorted(keys[:, 0], np.arange(capacity + 2)) if len(order) else np.zeros(capacity + 2, dtype=np.int64)
    values = np.array(order, dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                mine = length == x
                low, high = first_of[x], first_of[x + 1]
                at[mine] = low + np.searchsorted(keys[low:high, 1], rank[mine], side="right") - 1
            run, nth = values[at], rank - values[at, 1]
            out = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], names=[*out.schema.names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return ranked.select(*columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def tokenizer_path() -> str:
    """The tokenizer of the query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
