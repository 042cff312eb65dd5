import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import substring_dedup as s


def plain(docs, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in words:
        gone = {k + x for k in range(len(w) - window + 1 if i is not None else 0) if first[tuple(w[k : k + window])] < i for x in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def rows(frame):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def passages_of(words, n_docs, n_ids, seed):
    pick = random.Random(seed)
    text = [pick.choice("abcdefghijklmnop") for _ in range(words)]
    docs = []
    for k in range(n_docs):
        parts = []
        for _ in range(pick.randint(0, 4)):
            at, n = pick.randrange(words - 20), pick.choice([5, 12, 13, 14, 30])
            parts += text[at : at + n] + [f"own{k}"]
        docs.append((pick.randrange(-n_ids, n_ids), " ".join(parts)))
    return docs


@pytest.mark.parametrize("shares", [(1.0,), (0.2,) * 5])
def test_documents(spark, odd, shares):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (odd, docs):
        want = plain([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
        assert rows(s.dedup(frame, shares)) == want
    assert any(n for _, _, n, _ in want)


@pytest.mark.parametrize("held", [40, 2_000_000])
def test_random_passages_and_compaction(spark, monkeypatch, held):
    monkeypatch.setattr(s, "FANOUT", 3)
    monkeypatch.setattr(s, "HELD_WINDOWS", held)
    docs = passages_of(400, 80, 60, 6)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(s.dedup(frame, (0.2,) * 5)) == plain(docs)
    assert rows(s.dedup(frame, (0.5, 0.5), window=5)) == plain(docs, 5)


def test_batches_in_any_order(spark, monkeypatch):
    """Later batches may hold smaller ids; each is judged by what came before it and by itself."""
    monkeypatch.setattr(s, "FANOUT", 2)
    docs = passages_of(300, 90, 50, 8)
    index = s.WindowIndex(spark, 8)
    history = []
    for k in range(3):
        batch = docs[30 * k : 30 * k + 30]
        frame, past = (spark.createDataFrame(x, "doc_id long, text string") for x in (batch, history))
        got = rows(s.dedup_batch(frame, index, past if history else None))
        history += batch
        assert got == Counter((one[0], len(one[1].split()), *judged(one, history)) for one in batch)
    assert len(index.runs) == 1


def judged(one, rest, window=13):
    i, w = one[0], (one[1] or "").split()
    earlier = {tuple(v[k : k + window]) for j, t in rest if j < i for v in [(t or "").split()] for k in range(len(v) - window + 1)}
    gone = {k + x for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in earlier for x in range(window)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """With a hash that is the same for very many windows, words decide."""
    true = s._rolled
    monkeypatch.setattr(s, "_rolled", lambda h, words: true(h, words) % np.uint64(7) << np.uint64(60))
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(20)]
    lexicon = s.Lexicon()
    numbers, lengths = lexicon.numbers([t.split() for _, t in docs])
    _, start, h = s.windows(numbers, lengths, lexicon, 13)
    assert len(set(h.tolist())) <= 7 and not s.same_words(numbers, start[:1], numbers, start[-1:], 13).any()


def test_packing_of_numbers():
    pick = np.random.default_rng(1)
    x = pick.integers(-(2**63), 2**63 - 1, 1000)
    assert np.array_equal(s.unpacked([s.packed(x[:10]), s.packed(x[10:])]), x)
    h = np.sort(x.view(np.uint64))
    assert np.array_equal(s.undeltas([s.deltas(h)])[0], h)


def test_empty(spark, empty):
    assert s.dedup(empty).count() == 0
    assert s.dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), with_text=True).collect()[0].kept == "a b"
    none = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30)], "doc_id long, text string")
    assert rows(s.dedup(none)) == plain([(None, "a " * 30)] * 2)
