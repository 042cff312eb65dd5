import random
import time

from pyspark.sql import functions as F

from strata.llm import decontamination as d


def plain(text, items):
    """Items with a stretch of words, on one diagonal, in which matches less twice the substitutions stay positive and
    that holds a run of eight matching words or a mask's matches, and enough matches."""
    doc, out = d.words_of((text or "").encode()), set()
    for i, t in items:
        item = d.words_of((t or "").encode())
        if len(item) < d.SHORTEST:
            continue
        for shift in range(-len(item) + 1, len(doc)):
            same = {p for p in range(max(0, shift), min(len(doc), shift + len(item))) if doc[p] == item[p - shift]}
            for p in sorted(same):
                if any(p + len(m) <= min(len(doc), shift + len(item)) and all(p + k in same for k, c in enumerate(m) if c == "1") for m in d.MASKS):
                    n = best = 0
                    kept = 0
                    score = 0
                    for x in range(p, min(len(doc), shift + len(item))):
                        score += 1 if x in same else -2
                        n += x in same
                        if score > best:
                            best, kept = score, n
                    n = best = score = left = 0
                    for x in range(p - 1, max(0, shift) - 1, -1):
                        score += 1 if x in same else -2
                        n += x in same
                        if score > best:
                            best, left = score, n
                    if kept + left >= min(d.MATCHES, len(item)):
                        out.add(i)
    return sorted(out)


def test_against_plain_code(spark):
    random.seed(5)
    word = lambda: random.choice("abcdefgh") * random.randint(1, 3)
    items = [(k, " ".join(word() for _ in range(random.choice([5, 8, 10, 13, 30])))) for k in range(12)] + [(50, None), (51, "")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(random.randint(0, 40))]
        for _ in range(random.randint(0, 2)):
            t = random.choice(items[:12])[1].split()
            t = [w if random.random() > 0.12 else "ZZ" for w in t]
            at = random.randint(0, len(body))
            body[at:at] = t
        docs.append((k, " ".join(body).upper() + "."))
    docs += [(None, items[4][1]), (61, None), (7, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((-1 if i is None else i, plain(t, items)) for i, t in docs)
    for size in (16_000_000, 60):
        d.BLOCK_BYTES = size
        got = sorted((-1 if r.doc_id is None else r.doc_id, sorted(r["items"])) for r in d.overlaps(frame, bench).collect())
        assert got == want
    d.BLOCK_BYTES = 16_000_000
    assert any(x for _, x in want)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word word word word word word word word")], "item_id long, text string")
    assert sorted(r.doc_id for r in d.overlaps(odd, bench).collect() if r.contaminated) == [8]
    assert d.overlaps(empty, bench).count() == 0
    assert not any(r.contaminated or r["items"] for r in d.overlaps(odd, bench.limit(0)).collect())


def test_clashing_columns(spark, odd):
    docs = odd.withColumns({c: F.lit(c) for c in ("spans", "_row", "_kept", "items", "contaminated")})
    bench = spark.createDataFrame([(1, "word word word word word word word word")], "item_id long, text string")
    for size in (16_000_000, 1):
        d.BLOCK_BYTES = size
        got = d.overlaps(docs, bench.union(spark.createDataFrame([(2, "other " * 9)], bench.schema)), ("_row", "text", "spans", "_kept", "items"))
        assert got.columns == ["doc_id", "_row", "text", "_kept", "contaminated", "items", "spans"]
        assert {(r["_row"], r["_kept"]) for r in got.collect()} == {("_row", "_kept")}
    d.BLOCK_BYTES = 16_000_000


def test_one_word_everywhere():
    """As many hits as pairs of places, on few diagonals."""
    began = time.time()
    index = d.Index([(k, b"word " * 400) for k in range(3)])
    known = d.Hashes()
    found = index.overlaps(d.word_hashes(b"word " * 3000, known))
    assert time.time() - began < 10
    # on each diagonal one overlap, as long as the diagonal, where that is long enough
    want = {(i, max(0, s), min(3000, s + 400), min(3000, s + 400) - max(0, s)) for i in range(3) for s in range(-399, 3000)}
    assert set(found) == {x for x in want if x[3] >= d.MATCHES} and len(found) == len(set(found))
