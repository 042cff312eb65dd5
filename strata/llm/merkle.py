"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

Every row is a leaf. The leaves of a source, in the order of their doc_id, are hashed in runs of FAN, and so are the
digests that this gives, until one is left, the source's subroot. The subroots, in the order of their sources, are the
leaves of the top tree, which ends in the root. A leaf's proof is the digests of its siblings, level by level.

Proofs are made by pointer jumping: each node holds the siblings on its way to an ancestor, at first its parent.
A self-join gives it what that ancestor holds, so that the distance doubles, until all have reached the root. The
leaves, sixteen times as many as all other nodes, jump last and once: when their parents hold the whole way. Between
jumps the nodes are a table in the shared folder. Nodes with one ancestor far up are dealt by a salt, with a copy of
the ancestor for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.shared import cut, cut_at, forget, table

#: Nodes of a run, and bytes of a digest.
FAN, DIGEST = 16, 32
#: Nodes that meet one copy of their ancestor in a join.
MOST_A_COPY = 1024
#: The tree of the subroots; sources have 0, 1, ...
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(hexes: Column) -> Column:
    """sha256 of a text, as bytes."""
    return F.unhex(F.sha2(hexes.cast("binary"), 256))


def hex_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(value: Column) -> Column:
    """A value and its length in UTF-8 bytes before it; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(row: dict[str, Column]) -> Column:
    return digest(F.concat(*(field(row[c]) for c in COLUMNS)))


def lower_text(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def placed(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """df with `part` and `place`, its place (from 0) in the order of `by`, nulls first. Rows are dealt by ranges, and a
    range's places begin after the rows of those before; no task sees all rows. The dealt rows are written once, as
    ranges drawn a second time could be others."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), label)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("_n"))  # a row for each range
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "part").withColumn("place", F.col("_row") + F.col("_before")).drop("_row", "_before")


def depth(n: int) -> int:
    """Levels above n leaves; none above a lone one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def level_of(n: Column, most: int) -> Column:
    """depth() of a column of numbers up to `most`."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(depth(most))), F.lit(0))


def without(kids: Column, place: Column) -> Column:
    """The digests of a run but for that at `place`."""
    return F.concat(F.substring(kids, F.lit(1), (place * DIGEST).cast("int")), F.substring(kids, (place * DIGEST + DIGEST + 1).cast("int"), F.lit(FAN * DIGEST)))


def grow(level: DataFrame, most: int, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """level: tree, i and h of the nodes of some trees, with their tree's n at this level. Returns the nodes that are left
    alone (tree, h), and of each level above: tree, level, i, h, kids (the digests of its run) and last (nothing above)."""
    alone, above = [level.where("n = 1").select("tree", "h")], []
    for k in range(1, depth(most) + 1):
        runs = level.where("n > 1").groupBy("tree", F.floor(F.col("i") / FAN).alias("run"), F.ceil(F.col("n") / FAN).alias("n"))
        kids = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), F.lit(b""), lambda a, h: F.concat(a, h))  # FAN at most
        made = runs.agg(kids.alias("kids")).select("tree", F.lit(k).alias("level"), F.col("run").alias("i"), "n", digest(hex_of(F.col("kids"))).alias("h"), "kids")
        level = cut(made, f"{label}-{k}")
        above.append(level.select("tree", "level", "i", "h", "kids", (F.col("n") == 1).alias("last")))
        alone.append(level.where("n = 1").select("tree", "h"))
    out = alone[0]
    for x in alone[1:]:
        out = out.unionByName(x)
    return out, above


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def jumped(nodes: DataFrame, rounds: int) -> DataFrame:
    """nodes: tree, level, i, sub (the subroot's digest at the top tree's leaves), way (the siblings on the way to the
    pointer) and the pointer ptree, plevel, pi, null at the root. Afterwards all pointers are null: every way leads to the root."""
    pointer = [f"p{c}" for c in ("tree", "level", "i")]
    for k in range(rounds):
        nodes = cut(nodes, f"ways-{k}")
        copies = max(1, FAN ** (2**k) // MOST_A_COPY)
        copy = F.pmod(F.xxhash64("tree", "level", "i"), F.lit(copies)).cast("int")
        above = nodes.select(*(F.col(c).alias(f"p{c}") for c in ("tree", "level", "i")), F.col("sub").alias("_sub"), F.col("way").alias("_way"), *(F.col(c).alias(f"_{c}") for c in pointer))
        if copies > 1:  # of the few that are pointed at
            above = above.join(nodes.select(*pointer).distinct(), pointer, "left_semi")
        above = above.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        on = nodes.where("ptree IS NOT NULL").withColumn("_copy", copy).join(above, [*pointer, "_copy"])
        on = on.select("tree", "level", "i", F.coalesce("sub", "_sub").alias("sub"), F.concat("way", "_way").alias("way"), *(F.col(f"_{c}").alias(c) for c in pointer))
        nodes = nodes.where("ptree IS NULL").unionByName(on)
    return cut(nodes, "ways")


def manifest(docs: DataFrame, tamper: tuple[Column, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and steps of every row of docs (doc_id, source, lang, n_chars, text; other columns
    are ignored), and leaf_now. Digests are bytes. proof: the siblings' digests on end, from the leaf up. steps: an array of the
    place in each run on the way and the number of siblings there. tamper: which rows, and what becomes of their text, gives
    leaf_now, the leaf as it would be then; without it, and for rows that it leaves alone, leaf_now is the leaf.

    Null values are -, a null doc_id or source comes first, and rows with equal doc_id in a source are ordered by their leaf;
    those with the same leaf are the same row. An empty table gives no rows. Texts of any length are hashed whole.
    """
    spark = docs.sparkSession
    row = {c: F.col(c) for c in COLUMNS}
    now = F.when(tamper[0], leaf_of(row | {"text": tamper[1](row["text"])})) if tamper else F.lit(None).cast("binary")
    leaves, at = cut_at(docs.select("doc_id", "source", leaf_of(row).alias("h"), now.alias("now")), "leaves")
    leaves = placed(leaves, ["source", "doc_id", "h"], "ranged")
    forget(spark, at)

    # a row for each source, and for each source and range; a source's first place tells its rank
    shares = leaves.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = placed(shares.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("n")), ["first"], "sources")
    known = sources.select(F.col("source").alias("_source"), "first", "n", F.col("place").alias("tree"))
    of_range = shares.select("source", "part").join(known, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("part").alias("_part"), "first", "n", "tree")
    leaves = leaves.join(of_range, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    leaves = cut(leaves.select("doc_id", "source", "tree", (F.col("place") - F.col("first")).alias("i"), "n", "h", "now"), "placed")
    size = sources.agg(F.count("*").alias("trees"), F.max("n").alias("most")).collect()[0]
    trees, most = size["trees"], size["most"] or 0

    subroots, below = grow(leaves.select("tree", "i", "n", "h"), most, "level")
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(trees).cast("long").alias("n"), "h")
    top, upper = grow(cut(tops, "subroots"), trees, "top")
    root = (top.collect() or [None])[0]  # one row at most
    root = bytes(root["h"]) if root else b""

    # the nodes but for the leaves; a source's last one is a leaf of the top tree, and goes by that name
    is_last = F.col("last")
    below = [x.select(F.when(is_last, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("tree"), F.when(is_last, 0).otherwise(F.col("level")).alias("level"), F.when(is_last, F.col("tree")).otherwise(F.col("i")).alias("i"), "h", "kids", F.col("level").alias("under"), F.col("tree").alias("under_tree"), F.col("i").alias("under_i")) for x in below]
    lone = leaves.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("i"), "h", F.lit(None).cast("binary").alias("kids"), F.lit(0).alias("under"), F.col("tree").alias("under_tree"), F.col("i").alias("under_i"))
    above = [x.select("tree", "level", "i", "h", "kids", F.col("level").alias("under"), F.col("tree").alias("under_tree"), F.col("i").alias("under_i")) for x in upper]
    nodes = cut(union([lone, *below, *above]), "nodes")

    # first pointers: to the parent, whose run tells the siblings; a parent is known by the place that it has in its own tree
    parents = nodes.where("kids IS NOT NULL").select(F.col("under_tree").alias("_tree"), F.col("under").alias("_under"), F.col("under_i").alias("_i"), F.col("kids").alias("_kids"), F.col("h").alias("_h"), F.col("tree").alias("ptree"), F.col("level").alias("plevel"), F.col("i").alias("pi"))
    up = [F.col("_tree") == F.col("tree"), F.col("_under") == F.col("level") + 1, F.col("_i") == F.floor(F.col("i") / FAN)]
    ways = nodes.join(parents, up, "left")
    place = F.pmod(F.col("i"), F.lit(FAN))
    sub = F.when((F.col("tree") == TOP) & (F.col("level") == 0), F.col("h")).when((F.col("ptree") == TOP) & (F.col("plevel") == 0), F.col("_h"))
    way = F.when(F.col("ptree").isNull(), F.lit(b"")).otherwise(without(F.col("_kids"), place))
    first = ways.select("tree", "level", "i", sub.alias("sub"), way.alias("way"), "ptree", "plevel", "pi")
    distance = max(0, depth(most) - 1) + depth(trees)
    ways = jumped(first, max(0, distance - 1).bit_length())

    # the leaves' own jump
    held = ways.join(nodes.select("tree", "level", "i", "kids", "under", "under_tree", "under_i"), ["tree", "level", "i"]).select(F.col("under_tree").alias("_tree"), F.col("under").alias("_under"), F.col("under_i").alias("_i"), "kids", "way", "sub")
    lone = F.col("n") == 1
    out = leaves.withColumns({"_tree": F.col("tree"), "_under": F.when(lone, 0).otherwise(1), "_i": F.when(lone, F.col("i")).otherwise(F.floor(F.col("i") / FAN))}).join(held, ["_tree", "_under", "_i"])
    proof = F.when(lone, F.col("way")).otherwise(F.concat(without(F.col("kids"), place), F.col("way")))
    steps = F.concat(steps_of(F.col("i"), F.col("n"), most), steps_of(F.col("tree"), F.lit(trees).cast("long"), trees))
    return out.select("doc_id", "source", F.col("h").alias("leaf"), F.coalesce("now", "h").alias("leaf_now"), F.col("sub").alias("subroot"), F.lit(root).alias("root"), proof.alias("proof"), steps.alias("steps"))


def steps_of(i: Column, n: Column, most: int) -> Column:
    """place and siblings in the run of each level between leaf i of n and its tree's end."""
    out = []
    for k in range(depth(most)):
        at, nodes = F.floor(i / FAN**k), F.ceil(n / FAN**k)
        place = F.pmod(at, F.lit(FAN))
        out.append(F.when(nodes > 1, F.struct(place.cast("int").alias("place"), (F.least(F.lit(FAN), nodes - at + place) - 1).cast("int").alias("siblings"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<struct<place:int,siblings:int>>")


def folded(leaf: Column, proof: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    begin = F.struct(leaf.alias("h"), F.lit(1).alias("at"))

    def up(a: Column, s: Column) -> Column:
        left = F.substring(proof, a["at"], s["place"] * DIGEST)
        right = F.substring(proof, a["at"] + s["place"] * DIGEST, (s["siblings"] - s["place"]) * DIGEST)
        return F.struct(digest(hex_of(F.concat(left, a["h"], right))).alias("h"), (a["at"] + s["siblings"] * DIGEST).alias("at"))

    return F.aggregate(steps, begin, up, lambda a: a["h"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = manifest(table(spark, sf_dir, "documents"), (hit, lower_text))
    root = folded(F.col("leaf_now"), F.col("proof"), F.col("steps"))
    out = rows.select("doc_id", *(hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(hex_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), hex_of(root).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
#: SQL has no runs of digests over runs; a test holds the query against plain code.
ORACLE_SQL: dict[str, str] = {}
