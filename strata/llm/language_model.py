"""A hashed maximum-entropy language model with a class-factored softmax.

Classes are the leaves of a tree with WIDTH branches a node: P(word | history) is the product of the branches'
probabilities on the way to the word's leaf, times P(word | leaf). At every node a softmax over weights of hashed features
decides: the node with the last word; at the root and three levels down with the last two; at the root with the last
but one alone (skip); and a bias. The most frequent words and the end token have leaves of their own two levels down, the next DEEP_WORDS ones three
levels down, so that words have features within their classes. The leaf of any other word follows from its last
letters; within it the weights are logarithms of counts, less a discount that is left to words never seen.

Buckets of features grow with the vocabulary, between LEAST_BUCKETS and MOST_BUCKETS (25 MB of weights in all).
Training: documents are dealt to shards by a hash, whatever the tasks are; in each round a shard starts from the
weights of the last round and takes gradient steps (Adagrad) over its documents; the changes are averaged block by block
in a shuffle. Every training document is used once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, small_batches, table
from strata.llm.vocabulary import sums, token_counts

END = b"\n"
WIDTH, LEVELS = 16, 3
#: The first kinds of features, at each level, of: the last word, the last two, the last but one alone.
KINDS = (3, 1, 2)
#: A leaf is numbered by its way, 16 * 16 * 16; below the first DEEP branches of the root are leaves of the third level,
#: below the others of the second (with 0 as their last branch). The last branch has the leaves that words share.
LEAVES, DEEP, DEEP_WORDS, SHARED = WIDTH**LEVELS, 8, 8 * WIDTH**2, WIDTH
FREQUENT = (WIDTH - 1 - DEEP) * WIDTH
#: Rows of weights for each level and kind of feature: one for so many distinct words, a power of two within bounds.
WORDS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1024, 4096, 65_536
#: Rows of weights that are averaged together.
BLOCK = 2048
STEP, CHUNK = 0.3, 16_384
#: Shares of the training documents that each round takes, in eighths; shards of a round at least, and how many times as
#: large as their change to the weights they are.
ROUNDS, SHARDS, SHARD_SIZE = (1, 7), 32, 10
OWN_BYTES = 64


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def own_leaves(frequent: list[bytes]) -> dict[bytes, int]:
    """Leaves of the end token and of words, the most frequent first."""
    words = [w for w in frequent if w != END]
    near, far = [END, *words[: FREQUENT - 1]], words[FREQUENT - 1 : FREQUENT - 1 + DEEP_WORDS]
    # neighbours in the tree end alike
    by_end = lambda w: w[::-1]
    return {w: (DEEP * WIDTH + k) * WIDTH for k, w in enumerate(sorted(near, key=by_end))} | {w: k for k, w in enumerate(sorted(far, key=by_end))}


def leaf_of(token: bytes, own: dict[bytes, int]) -> int:
    """A leaf of its own, or one of the last SHARED ones by the last letters."""
    found = own.get(token)
    return LEAVES - WIDTH * SHARED + WIDTH * (zlib.crc32(token[-3:]) % SHARED) if found is None else found


def leaf_column() -> Column:
    """leaf_of() for the column `token` where it has no leaf of its own."""
    return (F.lit(LEAVES - WIDTH * SHARED) + F.lit(WIDTH) * F.pmod(F.crc32(F.substring("token", -3, 3)), F.lit(SHARED))).cast("int")


class Codes(dict):
    """A word's hash and leaf in one number, for words with a leaf of their own: few enough to stay in a processor's cache."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__((w, (zlib.crc32(w) << 12) | leaf) for w, leaf in own.items())

    def of(self, words: list[bytes]) -> np.ndarray:
        """The codes of these words in turn."""
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        far = np.flatnonzero(found < 0)
        if len(far):
            # many at once, leaves as leaf_of() has them where a word has none of its own
            new = [words[k] for k in far.tolist()]
            ends = np.fromiter(map(zlib.crc32, [w[-3:] for w in new]), np.int64, len(new))
            found[far] = (np.fromiter(map(zlib.crc32, new), np.int64, len(new)) << 12) | (LEAVES - WIDTH * SHARED + WIDTH * (ends % SHARED))
        return found


def joined(texts: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of these texts in turn, and how many each text has."""
    return codes.of(list(chain.from_iterable(texts))), np.array([len(t) for t in texts], dtype=np.int64)


def features(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of documents that follow one another: a number for each kind of feature (kinds x n), and leaves."""
    hashes = (codes >> 12).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(lengths)[:-1]] = True
    first[:1] = True
    one = np.zeros(n, dtype=np.uint64)
    one[1:] = hashes[:-1]
    one[first] = 0
    two = np.zeros(n, dtype=np.uint64)
    two[1:] = one[:-1]
    two[first] = 0
    with np.errstate(over="ignore"):
        kinds = np.stack([one, one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(31)])
    return kinds, codes & (LEAVES - 1)


def places(kinds: np.ndarray, node: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each feature (kinds x n) at a node."""
    with np.errstate(over="ignore"):
        h = (kinds + (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(44) & np.uint64(buckets - 1)).astype(np.int64)


class Weights:
    """Weights of features (level and kind, bucket, branch) and biases of nodes (level, node, branch)."""

    def __init__(self, buckets: int, bias: list[np.ndarray]):
        self.buckets, self.bias = buckets, bias
        self.of = np.zeros((sum(KINDS) * buckets, WIDTH), dtype=np.float32)
        self.room = np.empty((2, 0, WIDTH), dtype=np.float32)

    def level(self, level: int) -> np.ndarray:
        """Kinds x buckets x WIDTH."""
        start = sum(KINDS[:level]) * self.buckets
        return self.of[start : start + KINDS[level] * self.buckets].reshape(KINDS[level], self.buckets, WIDTH)

    def odds(self, level: int, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """exp of the sums of weights for all branches, in room that the next call takes again."""
        w, n = self.level(level), len(node)
        if self.room.shape[1] < n:
            self.room = np.empty((2, n, WIDTH), dtype=np.float32)
        z, more = self.room[:, :n]
        # all places are within bounds; with "clip" take() writes to its output at once
        self.bias[level].take(node, axis=0, out=z, mode="clip")
        for k in range(KINDS[level]):
            z += w[k].take(at[k], axis=0, out=more, mode="clip")
        np.clip(z, -60, 60, out=z)
        return np.exp(z, out=z)


def branches(kinds: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Level, numbers of the tokens whose way goes there, their features, node and branch."""
    for level in range(LEVELS):
        some = np.flatnonzero(leaf < DEEP * WIDTH**2) if level == 2 else slice(None)
        to, down = leaf[some], WIDTH ** (LEVELS - level - 1)
        yield level, some, kinds[: KINDS[level], some], to // (down * WIDTH), to // down % WIDTH


def log_probabilities(weights: Weights, kinds: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Of each token's leaf."""
    total = np.zeros(len(leaf))
    for level, some, own, node, branch in branches(kinds, leaf):
        p = weights.odds(level, places(own, node, weights.buckets), node)
        total[some] += np.log(p[np.arange(len(p)), branch] / np.einsum("ij->i", p))
    return total


def train(weights: Weights, seen: np.ndarray, kinds: np.ndarray, leaf: np.ndarray) -> None:
    """A gradient step for each chunk of tokens, in place. seen: the sum of squared steps of each row of weights."""
    total, cells = np.zeros((weights.buckets, WIDTH), dtype=np.float32), np.empty((CHUNK, WIDTH // 2), dtype=np.int64)
    # two branches are added at a time, as the two parts of a complex number
    pairs = total.view(np.complex64).reshape(-1)
    for start in range(0, len(leaf), CHUNK):
        for level, _, own, node, branch in branches(kinds[:, start : start + CHUNK], leaf[start : start + CHUNK]):
            at = places(own, node, weights.buckets)
            g = weights.odds(level, at, node)
            g /= np.einsum("ij->i", g)[:, None]
            g[np.arange(len(g)), branch] -= 1
            w, squares = weights.level(level), seen[level]
            for k in range(KINDS[level]):
                # gradients of equal rows are added up
                cell = np.add((at[k] * (WIDTH // 2))[:, None], np.arange(WIDTH // 2), out=cells[: len(g)])
                np.add.at(pairs, cell.reshape(-1), g.view(np.complex64).reshape(-1))
                row = np.flatnonzero(np.bincount(at[k], minlength=weights.buckets))
                step = total[row]
                total[row] = 0
                squares[k, row] += np.einsum("ij,ij->i", step, step)
                step *= (STEP / np.sqrt(squares[k, row] + 1.0))[:, None]
                w[k][row] -= step


def fit(docs: DataFrame, own: dict[bytes, int], weights: Weights, tokens: int) -> None:
    """Trains the weights in all rounds."""
    spark = docs.sparkSession
    # a shard's text is SHARD_SIZE times as large as the change that it hands on
    shards = max(SHARDS, math.ceil(6 * tokens / (SHARD_SIZE * 2 * weights.of.size)))
    eighth = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8))
    key = F.xxhash64("doc_id", "text")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    low = 0
    for share in ROUNDS:
        start = spark.sparkContext.broadcast(weights)  # MOST_BUCKETS bound it

        def run(batches: Iterator, start=start) -> Iterator:
            import copy

            import pyarrow as pa

            from strata.llm.shared import utf8

            codes, shard = Codes(own), None

            def change() -> pa.RecordBatch:
                blocks = range(0, len(mine.of), BLOCK)
                return pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks]), pa.array([shard // 32] * len(blocks)), pa.array([1] * len(blocks)), pa.array([(mine.of[b : b + BLOCK] - start.value.of[b : b + BLOCK]).astype(np.float16).astype(np.float32).tobytes() for b in blocks], pa.binary())], names=["block", "part", "n", "change"])

            for batch in batches:
                of, texts = batch.column(0).to_numpy(), [tokens_of(t) for t in utf8(batch.column(1))]
                for s in dict.fromkeys(of.tolist()):
                    if s != shard:
                        if shard is not None:
                            yield change()
                        shard, mine, seen = s, copy.deepcopy(start.value), np.zeros((LEVELS, max(KINDS), start.value.buckets), dtype=np.float32)
                    train(mine, seen, *features(*joined([texts[k] for k in np.flatnonzero(of == s).tolist()], codes)))
            if shard is not None:
                yield change()

        part = docs.where((eighth >= low) & (eighth < low + share))
        low += share
        dealt = part.select(F.pmod(key, F.lit(shards)).alias("shard"), "text", key.alias("key")).repartition(shards, "shard").sortWithinPartitions("shard", "key")
        changes = dealt.select("shard", "text").mapInArrow(run, "block long, part long, n long, change binary")
        # up to 32 shards' changes meet at first, then the sums of those
        for keys in (["block", "part"], ["block"]):
            changes = changes.groupBy(*keys).applyInArrow(_add, "block long, part long, n long, change binary")
        for row in changes.collect():  # as large as the weights
            at = row["block"] * BLOCK
            weights.of[at : at + BLOCK] += np.frombuffer(row["change"], dtype=np.float32).reshape(-1, WIDTH) / row["n"]
        start.unpersist()


def _add(t):
    import pyarrow as pa

    n, total = sum(t.column("n").to_pylist()), sum(np.frombuffer(x.as_py(), dtype=np.float32) for x in t.column("change"))
    return pa.table({"block": [t.column("block")[0].as_py()], "part": pa.array([0], pa.int64()), "n": pa.array([n], pa.int64()), "change": pa.array([total.tobytes()], pa.binary())})


def biases(of_leaf: np.ndarray) -> list[np.ndarray]:
    """Of each level and node, the logarithms of the branches' shares by counts of the leaves."""
    out = []
    for level in range(LEVELS):
        n = (of_leaf + 0.05).reshape(WIDTH**level, WIDTH, -1).sum(axis=2)
        out.append(np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


class Model:
    """What training gives: counts (token, n, leaf) as a table, the words with their own leaf, of all shared leaves tokens and
    distinct words, the discount, and the weights."""

    def __init__(self, training: DataFrame):
        """Learns from all rows of training (doc_id, text)."""
        counts = cut(token_counts(training, tokens_of), "words")
        top = [bytes(r["token"]) for r in counts.where(F.length("token") <= OWN_BYTES).orderBy(F.desc("n"), "token").limit(FREQUENT + DEEP_WORDS).collect()]
        self.own = own_leaves(top)
        spark = training.sparkSession
        leaves = spark.createDataFrame([(bytearray(w), k) for w, k in self.own.items()], "token binary, own int")  # some 2,000 rows
        self.counts = counts.join(F.broadcast(leaves), "token", "left").select("token", "n", F.col("own").isNotNull().alias("alone"), F.coalesce("own", leaf_column()).alias("leaf"))
        once = lambda k: F.count(F.when((F.col("n") == k) & ~F.col("alone"), 1))
        rows = self.counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("v"), once(1).alias("n1"), once(2).alias("n2")).collect()  # LEAVES at most
        self.n, self.v = np.zeros(LEAVES, dtype=np.int64), np.zeros(LEAVES, dtype=np.int64)
        for r in rows:
            self.n[r["leaf"]], self.v[r["leaf"]] = r["n"], r["v"]
        n1, n2 = sum(r["n1"] for r in rows), sum(r["n2"] for r in rows)
        self.discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        buckets = min(max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(int(self.v.sum()) / WORDS_A_BUCKET, 1)))), MOST_BUCKETS)
        self.weights = Weights(buckets, biases(self.n))
        fit(training, self.own, self.weights, int(self.n.sum()))

    def within(self, n: Column, leaf: Column) -> Column:
        """log10 P(word | leaf) of a word without its own leaf; n null: of a word never seen."""
        first = LEAVES - WIDTH * SHARED
        tokens, words = (F.element_at(F.array(*(F.lit(float(x)) for x in v[first::WIDTH])), ((leaf - first) / WIDTH).cast("int") + 1) for v in (self.n, self.v))
        unseen = F.when(tokens > 0, self.discount * words / tokens).otherwise(1.0)
        return F.log10(F.when(n.isNull(), unseen).otherwise((n - self.discount) / tokens))


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Learns from `training` and scores docs (both: doc_id, text; other columns are ignored).

    Returns for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (log10 probability of the
    smoothed unigrams) and score (of the model, for which a word never seen is one outcome of its leaf). A null or empty
    text is its end token alone. Rows with an equal or null doc_id each get a row. With an empty training table every
    token is unknown.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = Model(training)
    n, v = int(model.n.sum()), int(model.v.sum())
    z = n + 0.5 * (v + 1)
    own, weights = model.own, spark.sparkContext.broadcast(model.weights)
    values = model.counts.select("token", "n", F.log10((F.col("n") + 0.5) / F.lit(z)).alias("base_score"), F.when(F.col("alone"), 0.0).otherwise(model.within(F.col("n"), F.col("leaf"))).alias("in_class"), F.lit(1.0).alias("n_known"))
    # END is alone in its leaf even where no training text shows it
    absent = {"base_score": F.lit(float(np.log10(0.5 / z))), "in_class": F.when(F.col("token") == F.lit(END), 0.0).otherwise(model.within(F.lit(None).cast("long"), leaf_column()))}

    def start(place: dict[bytes, int]) -> Callable:
        codes = Codes(own)
        of_place = codes.of(list(place))

        def of(texts: list[bytes]) -> Iterator:
            for at in range(0, len(texts), 50):
                part = [tokens_of(t) for t in texts[at : at + 50]]
                lengths = np.array([len(t) for t in part], dtype=np.int64)
                every = list(chain.from_iterable(part))
                places_of = np.fromiter(map(place.get, every, repeat(-1)), np.int64, len(every))
                found = of_place[places_of] if len(of_place) else np.zeros(len(every), dtype=np.int64)
                far = np.flatnonzero(places_of < 0)
                found[far] = codes.of([every[k] for k in far.tolist()])
                ends = np.cumsum(lengths)
                kinds, leaf = features(found, lengths)
                got = np.concatenate([log_probabilities(weights.value, kinds[:, i : i + CHUNK], leaf[i : i + CHUNK]) for i in range(0, len(leaf), CHUNK)])
                of_text = np.add.reduceat(got, ends - lengths) / np.log(10)
                for t, p, m, s in zip(part, np.split(places_of, ends[:-1]), lengths.tolist(), of_text.tolist(), strict=True):
                    yield t, p, (float(m), s)

        return of

    out = sums(docs, start, values, "n", ["base_score", "in_class", "n_known"], ["n_tokens", "classes_score"], absent)
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("classes_score") + F.col("in_class")).alias("score"))


def held_out():
    """Documents that are scored but not learnt from; a null doc_id is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_language_model": op6_language_model}
ORACLE_SQL: dict[str, str] = {}
