import random
import re
from collections import Counter

import numpy as np
import xxhash

from strata.llm import simhash
from strata.llm.components import components


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def group(nodes, near):
    """Smallest id reachable of each id; nodes: (id, fingerprint)."""
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, f) in enumerate(nodes):
        for b, g in nodes[:k]:
            if (f ^ g).bit_count() <= near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_against_plain_code(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (odd, docs):
        rows = [(r.doc_id, fingerprint(r.text)) for r in frame.collect()]
        want = group([x for x in rows if x[0] is not None], 2)
        got = simhash.fingerprint_groups(frame).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in rows)
        assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.fingerprint_groups(empty).count() == 0


def test_links_with_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    random.seed(4)
    prints = [random.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # clusters and chains
        p = random.choice(prints[:40] + prints[-200:])
        prints.append(p ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) * random.randrange(2))
    nodes = list(enumerate(dict.fromkeys(prints)))
    frame = spark.createDataFrame([(i, p.to_bytes(8, "big"), b"") for i, p in nodes], "id long, prints binary, wide binary")
    got = {r.id: r.root for r in components(simhash.links(frame, 2)).collect()}
    assert {i: got.get(i, i) for i, _ in nodes} == group(nodes, 2)


def test_dense_shard():
    base = np.uint64(12345)
    points = np.array([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)] + [base], dtype=np.uint64)
    assert set(simhash.link_shard(points, 2)) == {0}


def test_components(spark):
    random.seed(1)
    chain = [(k, k + 1) for k in range(0, 200)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    random.shuffle(chain)
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {k: 500 for k in range(501, 600)}


def test_near_duplicates(spark, odd, empty):
    random.seed(2)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(3000)]
    docs, of = [], {}
    for k in range(120):
        words = random.choices(vocabulary, k=random.choice([60, 150, 400, 900]))
        docs.append((k, " ".join(words)))
        of[k] = k
        for c in range(3):  # copies with a few words changed
            w = list(words)
            for at in random.sample(range(len(w)), max(1, len(w) // 100)):
                w[at] = random.choice(vocabulary)
            i = 1000 + 10 * k + c
            docs.append((i, " ".join(w).title() if c == 2 else " ".join(w)))
            of[i] = k
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in docs for w in [t.lower().split()]}
    sure = [i for i in of if len(shingles[i] & shingles[of[i]]) >= 0.8 * len(shingles[i] | shingles[of[i]])]
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(of[g] == of[i] for i, g in got.items())  # nothing else is taken for a copy
    assert sum(got[i] == of[i] for i in sure) >= 0.97 * len(sure)
    assert {r.doc_id: r.group for r in simhash.near_duplicates(odd).collect()} == {1: 1, 5: 1, 7: 7, 8: 8, 9: 9}
    assert simhash.near_duplicates(empty).count() == 0


def test_passages_added_and_replaced(spark):
    rng, docs, pairs = random.Random(3), [], []
    for k in range(240):
        j = (0.81, 0.85, 0.9)[k % 3]
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        n = round(396 * (1 - j) / j) if k % 2 else round(396 * (1 - j) / (1 + j))
        new = [f"v{rng.randrange(5000)}" for _ in range(n)]
        other = base + new if k % 2 else base[:100] + new[4:] + base[100 + n - 4 :]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        pairs.append((2 * k, len(s & t) / len(s | t)))
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sure = [a for a, j in pairs if j >= 0.8]
    assert len(sure) > 230 and sum(got[a] == got[a + 1] for a in sure) >= 0.98 * len(sure)


def test_nothing_below_the_similarity(spark):
    rng, docs = random.Random(5), []
    for k in range(100):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"v{rng.randrange(5000)}" for _ in range(125)]))]
    got = {r.doc_id: r.group for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in docs}  # 0.76


def test_rows_of_one_id(spark):
    rows = [(3, "one two three four five six"), (5, "One two three four five six"), (5, "something else that stands alone here"), (5, "something ELSE that stands alone here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group, r.first) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, False), (5, 5, True)]


def test_shards_dealt_by_pairs_of_parts_link_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def both():
        a = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.fingerprint_groups(docs).collect())
        b = sorted((r.doc_id, r.group, r.first) for r in simhash.near_duplicates(docs).collect())
        return a, b

    whole = both()
    monkeypatch.setattr(simhash, "MOST", 20)  # shards of about fifty parts
    assert both() == whole


def test_every_two_points_of_a_shard_meet():
    part = np.array([0, 1, 2, 0, 1, 3])
    rows, pairs = simhash.pair_numbers(part, np.full(6, 4))
    met = {frozenset((a, b)) for p in set(pairs.tolist()) for a in rows[pairs == p].tolist() for b in rows[pairs == p].tolist()}
    assert len(met) == 6 * 7 // 2 and len(rows) == 24


def test_sets_of_a_shard_against_plain_code():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 12_000, n).astype(np.uint64)) for n in (0, 1, 30, 5000, 9000, 9000)]
    sets += [np.unique(np.r_[sets[3][: 5000 - k], rng.integers(20_000, 30_000, k).astype(np.uint64)]) for k in (0, 200, 400, 900)]
    plain = [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets[2:]]
    assert simhash.common(sets[2:], sets).tolist() == plain
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    far = a != b
    got = simhash.link_sets(iter([(a[far], b[far], None)]), np.arange(len(sets)), sets, 0.8)
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and len(sets[i])}
    assert {(max(p), min(p)) for p in zip(*(x.tolist() for x in got), strict=True)} <= alike
    one, all_ = simhash.Groups(len(sets)), simhash.Groups(len(sets))
    one.join(*got)
    all_.join(*(np.array(x) for x in zip(*alike, strict=True)))
    assert one.root.tolist() == all_.root.tolist() and len(got[0]) < len(alike)


def test_links_that_only_sets_of_a_shard_show(spark, monkeypatch):
    """Near copies of one text, many of them too unlike each other; no two are linked before."""
    from pyspark.sql import functions as F

    rng, docs = random.Random(8), []
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(400), 4 + k % 5):
            w[at] = f"v{rng.randrange(5000)}"
        docs.append((k, " ".join(w)))
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in docs for w in [t.split()]}
    alike = [(i, j) for i in range(60) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.75 * len(shingles[i] | shingles[j])]
    want = simhash.Groups(60)
    want.join(*(np.array(x) for x in zip(*alike, strict=True)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = simhash.signatures(frame).withColumn("id", F.col("doc_id"))
    sets = simhash.shingle_sets(frame, found.select("id", "doc_id", "text_hash"), 5)
    sized = found.join(sets.select("id", (F.octet_length("set") / 8).cast("long").alias("size")), "id").select("id", "prints", "wide", "size", F.col("id").alias("label"))
    for most in (simhash.SET_BYTES, 20_000):  # as one group, and dealt out by pairs of parts
        monkeypatch.setattr(simhash, "SET_BYTES", most)
        rows = simhash.set_links(sized, sets, simhash.RADIUS, simhash.wide_distance(0.75), 0.75).collect()
        assert all(len(shingles[r.a] & shingles[r.b]) >= 0.75 * len(shingles[r.a] | shingles[r.b]) for r in rows)
        got = simhash.Groups(60)
        got.join(np.array([r.a for r in rows]), np.array([r.b for r in rows]))
        assert len(alike) > 100 and (got.root == want.root).mean() > 0.95


def test_several_trees_have_as_many_shards_as_one(spark, monkeypatch):
    """So a point has fewer boundaries to go to both sides of, and no more copies of it for more points."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "SHARD", 50)
    points = spark.range(600).select("id", F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64("id", F.lit(k)).bitwiseAND(2**32 - 1)), 16, "0") for k in range(12)))).alias("prints"), F.lit(b"").alias("wide"))
    got = simhash.routed(points, 2).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert sorted(r.n for r in got) == [600] * 12
