"""SimHash near-duplicates, found by vantage-point trees.

A fingerprint's bit is 1 if it is set in over half the hashes of a text's shingles, so similar texts have near
fingerprints. A tree of vantage points is fitted on a bounded sample of fingerprints: each node holds a point and a
radius, and sends fingerprints inside the radius one way and the others the other way. By the triangle inequality two
fingerprints within the link distance either go the same way, or the outer one lies within that distance of the
radius; such boundary fingerprints go both ways. So each pair of near fingerprints meets in a shard. Spark groups
the shards, a task links what is near within one, dividing it further by the same rule, and components over all shards give the
groups. A shard hands on a link from each fingerprint to one of its group there, not all pairs.

near_duplicates() is for texts of five-word shingles that share SIMILARITY or more of them. One fingerprint by majority
of such texts differs in ten bits or so of 64, where a tree prunes nothing. So its fingerprints have a bit each of the
least of the shingles under many orders, which differs in (1 - similarity) / 2 of the bits wherever the texts differ;
several short ones have a tree each, and nearly all similar texts are within RADIUS in one of them. More of these bits
drop what is far, and the shingles themselves then decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.components import components
from strata.llm.shared import cut, sifted, small_batches, spread_sample, table

SEED = 42
#: Fingerprints that the trees are fitted on at most, and those that a shard should hold, for each of the trees: several trees
#: have as many shards in all as one, and fewer boundary points.
SAMPLE, SHARD = 16_384, 32_768
#: Points that a task routes at once.
HELD = 16_384
#: A shard is divided until its parts are so small.
BLOCK = 512
#: Points of a shard that a task takes at once, about; a larger shard is dealt to tasks by pairs of such parts.
MOST = 1 << 22
#: near_duplicates: trees and bits of a tree's fingerprint, those of the wide one (the first trees' together); distance of
#: links. Of texts at a similarity of 0.8, 0.367 are within 2 of 32 bits, and 0.996 so in one of 12 trees.
TREES, TREE_BITS, WIDE_BITS, RADIUS = 12, 32, 384, 2
SHINGLE, SIMILARITY = 5, 0.8
#: Pairs that share one copy of a text's shingles when they are compared.
HOT = 256
#: Bytes of sets that a task compares, about, and elements that it looks at together.
SET_BYTES, COLUMNS = 32 << 20, 4096
#: More than the nodes of a tree; a shard's number tells its tree.
TREE_SHARDS = 1_000_000
_ORDERS = np.random.default_rng(SEED).integers(0, 2**63, TREES * TREE_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(16)], dtype=np.uint64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, in lower case and joined by a space; of all words if there are fewer."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same things, by number."""
    h = hashes * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_bits(hashes: np.ndarray) -> np.ndarray:
    """A bit of the least hash under each of the orders, as TREES numbers of TREE_BITS."""
    least = np.full(len(_ORDERS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _ORDERS[:, None]).min(axis=1), out=least)
    return np.packbits((mixed(least, 1) >> np.uint64(40)).astype(np.uint8) & 1, bitorder="little").view("<u4")


class Tree:
    """Vantage points over fingerprints of 64 bits or fewer. nodes: (point, radius, inner, outer), or None for a shard."""

    def __init__(self, sample: np.ndarray, shards: int, near: int):
        self.near, self.nodes = near, []
        self.leaf = max(8, len(sample) // max(shards, 1))
        self._grow(sample, np.random.default_rng(SEED))

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(points) > self.leaf and (cut_at := best_cut(points, self.near, rng)):
            point, radius = cut_at
            d = np.bitwise_count(points ^ point)
            self.nodes[me] = (point, radius, self._grow(points[d <= radius], rng), self._grow(points[d > radius], rng))
        return me

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of points and the shards that they go to, boundary points to several."""
        rows, shards, todo = [], [], [(0, np.arange(len(points)))]
        while todo:
            k, idx = todo.pop()
            if self.nodes[k] is None:
                rows.append(idx)
                shards.append(np.full(len(idx), k))
            elif len(idx):
                point, radius, inner, outer = self.nodes[k]
                d = np.bitwise_count(points[idx] ^ point)
                todo += [(inner, idx[d <= radius + self.near]), (outer, idx[d > radius])]
        return np.concatenate(rows), np.concatenate(shards)


def best_cut(points: np.ndarray, near: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of some, that leave the least work on both sides; None if none saves a tenth."""
    best, found, n = 0.9 * len(points) ** 2, None, len(points)
    for point in [*rng.choice(points, 4), *rng.integers(0, 2**63, 4, dtype=np.uint64)]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ point), minlength=66 + near))
        inner, outer = within[near : 65 + near].astype(float), (n - within[:65]).astype(float)
        cost = np.where((outer > 0) & (inner < n), inner**2 + outer**2, np.inf)
        r = int(cost.argmin())
        if cost[r] < best:
            best, found = cost[r], (point, r)
    return found


class Groups:
    """The groups of numbered things within a shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]."""
        n = len(self.root)
        pairs = np.unique(np.minimum(self.root[a], self.root[b]) * n + np.maximum(self.root[a], self.root[b]))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for p in pairs.tolist():
            x, y = find(p // n), find(p % n)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            to = np.arange(n)
            for x in parent:
                to[x] = find(x)
            self.root = to[self.root]


def blocks(points: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of fingerprints of a shard, block by block, so that all within `near` meet."""
    rng, todo = np.random.default_rng(SEED), [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        if len(idx) < 2:
            continue
        part = points[idx]
        if len(idx) > BLOCK and (found := best_cut(part if len(part) <= 4096 else part[:: len(part) // 4096], near, rng)):
            d = np.bitwise_count(part ^ found[0])
            inner, outer = idx[d <= found[1] + near], idx[d > found[1]]
            if len(inner) < len(idx) and len(outer) < len(idx):
                todo += [inner, outer]
                continue
        for i in range(0, len(idx), BLOCK):
            for j in range(i, len(idx), BLOCK):
                yield idx[i : i + BLOCK], idx[j : j + BLOCK]


def link_shard(points: np.ndarray, near: int) -> np.ndarray:
    """For each fingerprint of a shard, one of its group: groups are of fingerprints within `near`."""
    groups = Groups(len(points))
    for x, y in blocks(points, near):
        a, b = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= near)
        a, b = x[a], y[b]
        new = groups.root[a] != groups.root[b]
        if new.any():
            groups.join(a[new], b[new])
    return groups.root


def meetings(points: np.ndarray, near: int, wide: np.ndarray, wide_near: int, label: np.ndarray | None = None, size: np.ndarray | None = None, share: float = 0.0, tree: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block the pairs of a shard within `near`, each both ways round, whose wide fingerprints are within wide_near, and how far those are apart.
    With labels, those whose labels differ and of whose sizes the smaller is that share of the larger or more; with a tree's number, those that are
    not within `near` in a tree before it, where they meet too."""
    before = np.ascontiguousarray(wide).view("<u4")[:, :tree]
    for x, y in blocks(points, near):
        a, b = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= near)
        a, b = x[a], y[b]
        go = a != b if label is None else (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b]) - 1e-9)
        a, b = a[go], b[go]
        d = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
        go = d <= wide_near
        a, b, d = a[go], b[go], d[go]
        if tree:
            go = (np.bitwise_count(before[a] ^ before[b]) > near).all(axis=1)
            a, b, d = a[go], b[go], d[go]
        if len(a):
            yield a, b, d


def nearest(met: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n points those in such pairs, and the nearest that each has there."""
    best, to = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for a, b, d in met:
        for p, q in ((a, b), (b, a)):
            order = np.lexsort((d, p))
            p, q, e = p[order], q[order], d[order]
            first = np.r_[True, p[1:] != p[:-1]]
            p, q, e = p[first], q[first], e[first]
            less = e < best[p]
            best[p[less]], to[p[less]] = e[less], q[less]
    a = np.flatnonzero(to >= 0)
    return a, to[a]


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x has in common with each of y."""
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    rows = [np.repeat(np.arange(len(s)), [len(t) for t in s]) for s in (x, y)]
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    places = []
    for s, r in zip((x, y), rows, strict=True):
        value = np.concatenate(s)
        at = np.searchsorted(both, value)
        here = at < len(both)
        here[here] = both[at[here]] == value[here]
        order = np.argsort(at[here], kind="stable")
        places.append((at[here][order], r[here][order]))
    for start in range(0, len(both), COLUMNS):
        left, right = (np.zeros((len(s), COLUMNS), dtype=np.float32) for s in (x, y))
        for m, (at, r) in zip((left, right), places, strict=True):
            i, j = np.searchsorted(at, [start, start + COLUMNS])
            m[r[i:j], at[i:j] - start] = 1
        total += (left @ right.T).astype(np.int64)
    return total


def link_sets(met: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard whose sets have that Jaccard similarity or more: enough of them to link all labels that any of them link."""
    names, of = np.unique(label, return_inverse=True)
    groups, out = Groups(len(names)), []
    for a, b, _ in met:
        open_yet = groups.root[of[a]] != groups.root[of[b]]
        a, b = a[open_yet], b[open_yet]
        if not len(a):
            continue
        x, i = np.unique(a, return_inverse=True)
        y, j = np.unique(b, return_inverse=True)
        both = common([sets[k] for k in x], [sets[k] for k in y])[i, j]
        n = np.array([len(s) for s in sets])
        like = both >= similarity * (n[a] + n[b] - both) - 1e-9
        for p, q in zip(a[like].tolist(), b[like].tolist(), strict=True):
            if groups.root[of[p]] != groups.root[of[q]]:
                groups.join(of[[p]], of[[q]])
                out.append((p, q))
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def pair_numbers(part: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points in a part of a shard of so many, which point it is and the number of each pair of parts that it belongs to."""
    rows = np.repeat(np.arange(len(part)), parts)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = part[rows]
    return rows, np.minimum(own, other) * parts[rows] + np.maximum(own, other)


def held(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrow batches of id, prints and wide as arrays of bytes, a row for each of some HELD points."""
    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            ids = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), dtype="<i8").view(np.uint8).reshape(-1, 8)
            parts.append((ids, *(np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(ids), -1 if len(c[0].as_py()) else 0) for c in batch.columns[1:])))
            n += len(ids)
        if n >= HELD:
            yield tuple(map(np.concatenate, zip(*parts, strict=True)))
            parts, n = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def packed(records: np.ndarray) -> bytes:
    """Rows of bytes as one string, column by column: a column in which rows hardly differ takes next to nothing when compressed."""
    return np.ascontiguousarray(records.T).tobytes()


def unpacked(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, fingerprints and wide fingerprints (numbers of 64 bits) of a shard's rows as routed() packs them."""
    records = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(-1, n).T for n, b in zip(t.column("n").to_pylist(), t.column("data").to_pylist(), strict=True)])
    whole = np.ascontiguousarray(records).view("<u8")
    return whole[:, 0].astype(np.int64), whole[:, 1].astype(np.uint64), whole[:, 2:]


def routed(points: DataFrame, near: int) -> DataFrame:
    """points: id (long), prints (binary: fingerprints of eight bytes, the greatest first, one a tree), wide (binary of a multiple of eight bytes, may
    be empty). Returns shard, pair, n and data: each point in all shards that it goes to, n of them packed into a row. A shard of more than MOST points
    is dealt out in parts, and its points stand with each pair of parts that they belong to, so that any two of them still meet and no group grows with the data."""
    spark = points.sparkSession
    n = points.count()
    sample = spread_sample(points, "id", SAMPLE, n).select("prints").toPandas()["prints"]
    prints = np.frombuffer(b"".join(sample), dtype=">u8").astype(np.uint64).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1), dtype=np.uint64)
    trees = spark.sparkContext.broadcast([Tree(np.unique(prints[:, k]), math.ceil(n / (SHARD * prints.shape[1])), near) for k in range(prints.shape[1])])

    def each(batches: Iterator) -> Iterator:
        """For some points and each tree: ids, fingerprints of the tree and wide ones, and which go to which shard."""
        for ids, raw, wide in held(batches):
            all_prints = raw.view(">u8").astype("<u8")
            for k, tree in enumerate(trees.value):
                rows, shards = tree.route(all_prints[:, k])
                yield ids, all_prints[:, k], wide, rows, shards + k * TREE_SHARDS

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter[int] = Counter()
        for *_, shards in each(batches):
            names, sizes = np.unique(shards, return_counts=True)
            total.update(dict(zip(names.tolist(), sizes.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["shard", "n"])

    # as many rows as the trees have leaves, which a sample of SAMPLE bounds
    sizes = points.select("id", "prints", F.lit(b"").alias("wide")).mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > MOST).collect()
    parts_of = {r["shard"]: math.ceil(r["n"] / MOST) for r in sizes}

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, prints, wide, rows, shards in each(batches):
            pair = np.zeros(len(rows), dtype=np.int64)
            if parts_of:
                parts = np.array([parts_of.get(x, 1) for x in shards.tolist()], dtype=np.int64)
                part = (mixed(ids.view("<u8")[rows, 0], 2) % parts.astype(np.uint64)).astype(np.int64)
                copies, pair = pair_numbers(part, parts)
                rows, shards = rows[copies], shards[copies]
            order = np.lexsort((rows, pair, shards))
            rows, shards, pair = rows[order], shards[order], pair[order]
            records = np.concatenate([ids, np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), wide], axis=1)
            first = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (pair[1:] != pair[:-1])])
            runs = np.split(rows, first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(shards[first]), pa.array(pair[first]), pa.array([len(r) for r in runs], pa.int32()), pa.array([packed(records[r]) for r in runs], pa.binary())], names=["shard", "pair", "n", "data"])

    return points.select("id", "prints", "wide").mapInArrow(route, "shard long, pair long, n int, data binary")


def links(points: DataFrame, near: int) -> DataFrame:
    """points as routed() takes them. Returns a and b: ids that are linked directly or through others of a shard; every
    link between two ids is one of these or follows from several."""

    def link(t):
        import pyarrow as pa

        ids, prints, _ = unpacked(t)
        root = link_shard(prints, near)
        far = root != np.arange(len(ids))
        return pa.table({"a": ids[far], "b": ids[root[far]]})

    return routed(points, near).groupBy("shard", "pair").applyInArrow(link, "a long, b long")


def candidates(points: DataFrame, near: int, wide_near: int, share: float = 0.0) -> DataFrame:
    """points as routed() takes them, and label and size (long) where only pairs of different labels are wanted, whose sizes could have that
    share in common. Returns a < b: the nearest of each point in each shard."""
    labelled = "label" in points.columns
    if labelled:
        points = with_label(points)

    def pair(t):
        import pyarrow as pa

        ids, prints, wide = unpacked(t)
        met = meetings(prints, near, *of_label(wide, wide_near), share) if labelled else meetings(prints, near, wide, wide_near)
        a, b = nearest(met, len(ids))
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return routed(points, near).groupBy("shard", "pair").applyInArrow(pair, "a long, b long").distinct()


def with_label(points: DataFrame) -> DataFrame:
    """points with label and size before the wide fingerprint's bytes."""
    return points.withColumn("wide", F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("label", "size")), "wide"))


def of_label(wide: np.ndarray, wide_near: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """What meetings() takes of such bytes."""
    return wide[:, 2:], wide_near, wide[:, 0], wide[:, 1].byteswap().astype(np.int64)


def set_links(points: DataFrame, sets: DataFrame, near: int, wide_near: int, similarity: float) -> DataFrame:
    """points as routed() takes them, wide having all trees' fingerprints, with label and size; sets: id and set. Returns a and b whose sets have that
    similarity, enough of them to link all labels that any pair of points links. The sets go to those shards alone where their points
    have others to be compared with, and are compared there, so that not a row is made for a pair that fails. Shards with many
    bytes of sets are dealt out by pairs of parts."""

    def wait(key, t):
        import pyarrow as pa

        ids, prints, wide = unpacked(t)
        a, _ = nearest(meetings(prints, near, *of_label(wide, wide_near), similarity, key[0].as_py() // TREE_SHARDS), len(ids))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(a), pa.int64()), "pair": pa.array([key[1].as_py()] * len(a), pa.int64()), "id": ids[a], "print": prints[a].view(np.int64)})

    places = cut(routed(with_label(points), near).groupBy("shard", "pair").applyInArrow(wait, "shard long, pair long, id long, print long"), "places")
    points = points.select("id", "label", "size", "wide")
    parts = places.join(points.select("id", "size"), "id").groupBy("shard", "pair").agg(F.ceil(F.sum("size") * 8 / SET_BYTES).cast("int").alias("parts"))
    dealt = places.join(parts, ["shard", "pair"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("sub", F.least("part", "other") * F.col("parts").cast("long") + F.greatest("part", "other"))

    def link(key, t):
        import pyarrow as pa

        ids, prints, label, size = (t.column(c).to_numpy() for c in ("id", "print", "label", "size"))
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), dtype="<u8").reshape(len(ids), -1)
        met = meetings(prints.view(np.uint64), near, wide, wide_near, label, size, similarity, key[0].as_py() // TREE_SHARDS)
        a, b = link_sets(met, label, [np.frombuffer(s, dtype=np.uint64) for s in t.column("set").to_pylist()], similarity)
        return pa.table({"a": ids[a], "b": ids[b]})

    whole = dealt.select("shard", "pair", "sub", "id", "print").join(points, "id").join(sets, "id")
    return whole.groupBy("shard", "pair", "sub").applyInArrow(link, "a long, b long")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint (long) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        for batch in batches:
            found = np.array([majority(shingle_hashes(t, words)) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


def fingerprint_groups(docs: DataFrame, words: int = 3, near: int = 2) -> DataFrame:
    """Groups of every row of docs (doc_id, text; other columns are ignored) by fingerprints that link at `near`
    differing bits or fewer.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable. A null or empty text
    has fingerprint zero and is linked like any other. Rows with an equal doc_id each get a row and are one node; a
    null doc_id is no node's name, so its rows have the group of their fingerprint, or null. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    found = cut(fingerprints(docs, words), "prints")
    # rows of one fingerprint, however many, are one point
    points = cut(found.groupBy("print").agg(F.min("doc_id").alias("id")), "points")
    as_bytes = F.unhex(F.lpad(F.hex("print"), 16, "0"))
    roots = components(links(points.where("id IS NOT NULL").select("id", as_bytes.alias("prints"), F.lit(b"").alias("wide")), near))
    group = points.join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("component_id"))
    return found.join(group, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(table(spark, sf_dir, "documents"))


def wide_distance(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits of wide fingerprints up to which texts are compared: what shingle sets of that Jaccard similarity
    differ by, and three standard deviations."""
    p = (1 - similarity) / 2
    return round(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def signatures(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, key (of the text's words in lower case), prints and wide of every row with words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        from strata.llm.shared import utf8

        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                hashes = shingle_hashes(text, words)
                if not len(hashes):
                    continue
                bits = least_bits(hashes)
                rows.append((doc, text_hash, xxhash.xxh3_128_digest(b" ".join(text.lower().split())), bits.astype(">u8").tobytes(), bits[: WIDE_BITS // TREE_BITS].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["doc_id", "text_hash", "key", "prints", "wide"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, key binary, prints binary, wide binary")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """id and set (binary: the sorted hashes of the text's shingles). nodes: id, doc_id and text_hash of its text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in utf8(batch.column(1))], pa.binary())], names=["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    # most texts are no node, and are not shuffled
    texts, _ = sifted(texts, nodes.select("doc_id", "text_hash"))
    # rows that are the same in id and text are one node; they lie together after the join
    return texts.join(nodes, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "id"]).select("id", "text").mapInArrow(run, "id long, set binary")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity or more."""
    # a text in many pairs has a copy of its set for every HOT of them
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    parts = ends.groupBy("id").agg(F.ceil(F.count("*") / HOT).alias("parts"))
    salted = sets.join(parts, "id").select("id", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt"), "set")
    hot = parts.where("parts > 1")
    for end, other in (("a", "b"), ("b", "a")):
        pairs = pairs.join(hot.select(F.col("id").alias(end), "parts"), end, "left").withColumn(f"salt_{end}", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    for end in ("a", "b"):
        pairs = pairs.join(salted.select(F.col("id").alias(end), F.col("salt").alias(f"salt_{end}"), F.col("set").alias(f"set_{end}")), [end, f"salt_{end}"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Groups the rows of docs (doc_id, text) whose texts are the same words, or share `similarity` or more of their
    shingles: every link is of two texts whose sets of shingles were compared.

    Returns doc_id, text_hash, group (the smallest doc_id of the group) and first (this row's id and text stand for
    the group) of every row that has words and a doc_id. Texts without words are no copies of each other.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL")
    found = cut(signatures(docs, words), "signatures")
    # copies, however many, are one point, known by the 128 bits of its words; the table gives it a number
    points = found.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("prints").alias("prints"), F.first("wide").alias("wide"))
    points = cut(points.withColumn("id", F.monotonically_increasing_id()), "points")
    # the nearest of each point are compared first
    limit = wide_distance(similarity)
    pairs = cut(candidates(points, RADIUS, limit), "pairs")
    met = cut(points.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"), "met")
    sets = cut(shingle_sets(docs, met.select("id", "at.*"), words), "sets")
    linked = cut(alike(pairs, sets, similarity), "links")
    # sets that share 0.8 of their elements are no more unlike in size
    sized = cut(met.select("id", "prints", "wide").join(sets.select("id", (F.octet_length("set") / 8).cast("long").alias("size")), "id"), "sized")

    def labelled() -> DataFrame:
        return cut(sized.join(components(linked).withColumnRenamed("root", "label"), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")

    # then the nearest of each point in another group, and all that is left between groups within the shards
    rest = cut(candidates(labelled(), RADIUS, limit, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
    linked = linked.union(cut(alike(rest, sets, similarity), "links"))
    linked = linked.union(cut(set_links(labelled(), sets, RADIUS, limit, similarity), "links"))
    roots = components(linked)
    root = points.join(roots, "id", "left").select("key", "at", F.coalesce("root", "id").alias("root"))
    first = root.groupBy("root").agg(F.min("at").alias("first"))
    group = cut(root.join(first, "root").select("key", "first"), "groups")
    return found.select("doc_id", "text_hash", "key").join(group, "key").select("doc_id", "text_hash", F.col("first.doc_id").alias("group"), (F.col("first") == F.struct("doc_id", "text_hash")).alias("first"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
