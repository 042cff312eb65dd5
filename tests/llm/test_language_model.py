import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import language_model as lm


def want(rows):
    tokens = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 1 if r.doc_id is not None else False, [*(r.text or "").encode().lower().split(), b"\n"]) for r in rows]
    c = Counter(w for _, h, t in tokens if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if i is None else i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, h, t in tokens)


@pytest.mark.parametrize("head", [200_000, 40])
def test_counts_and_scores(spark, monkeypatch, head):
    from strata.llm import vocabulary

    monkeypatch.setattr(vocabulary, "HEAD", head)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.score(docs, docs.where(~lm.held_out())).withColumn("held_out", lm.held_out()).collect()
    for g, w in zip(sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), want(docs.collect()), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5])
    out = [r for r in got if r.held_out]
    assert sum(r.score - r.base_score for r in out) >= 0.3 * sum(r.n_tokens for r in out)  # it has learnt what holds elsewhere


def test_odd_rows(spark, odd, empty):
    got = lm.score(odd, odd.where(~lm.held_out())).withColumn("held_out", lm.held_out()).collect()
    for g, w in zip(sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), want(odd.collect()), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
    assert lm.score(empty, empty).count() == 0
    assert {r.n_known for r in lm.score(odd, empty).collect()} == {0}


def plain_score(model, text, counts):
    """The same by one token after another, from the model's weights."""
    mask, w = 2**64 - 1, model.weights
    words = [*text.encode().lower().split(), lm.END]
    h = [0, 0, *(zlib.crc32(x) + 1 for x in words)]
    total = 0.0
    for k, word in enumerate(words):
        one, two = h[k + 1], h[k]
        kinds = [one, (one * 0x9E3779B97F4A7C15 + two * 0xC2B2AE3D27D4EB4F) & mask, two * 31]
        leaf = lm.leaf_of(word, model.own)
        way = [leaf // 256, leaf // 16 % 16, leaf % 16]
        for level, branch in enumerate(way[: 3 if leaf < 8 * 256 else 2]):
            node = sum(b * 16 ** (level - 1 - i) for i, b in enumerate(way[:level]))
            at = [((((x + (node + 1) * 0xD6E8FEB86659FD93) & mask) * 0xBF58476D1CE4E5B9 & mask) >> 44) & (w.buckets - 1) for x in kinds]
            z = [float(w.bias[level][node][b]) + sum(float(w.level(level)[i][at[i]][b]) for i in range(lm.KINDS[level])) for b in range(16)]
            total += z[branch] - math.log(sum(map(math.exp, z)))
        if word not in model.own:
            n, v = int(model.n[leaf]), int(model.v[leaf])
            p = (counts[word] - model.discount) / n if counts[word] else model.discount * v / n if n else 1.0
            total += math.log(p)
    return total / math.log(10)


def test_scores_equal_plain_ones(spark, monkeypatch):
    """On a small table, with few words that have leaves of their own; documents in other tasks change nothing."""
    monkeypatch.setattr(lm, "FREQUENT", 6)
    monkeypatch.setattr(lm, "DEEP_WORDS", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    training = docs.where(~lm.held_out())
    model = lm.Model(training)
    rows = docs.collect()
    counts = Counter(w for r in training.collect() for w in [*(r.text or "").encode().lower().split(), lm.END])
    got = {r.doc_id: r.score for r in lm.score(docs.repartition(7), training.repartition(5)).collect()}
    for r in rows[:25]:
        assert got[r.doc_id] == pytest.approx(plain_score(model, r.text or "", counts), rel=2e-3)
    assert sum(map(len, ([w for w in counts if lm.leaf_of(w, model.own) == x and w not in model.own] for x in range(0, lm.LEAVES, lm.WIDTH)))) == len(counts) - len(model.own)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = lm.Weights(4096, lm.biases(rng.integers(0, 9, lm.LEAVES)))
    weights.of[:] = rng.normal(size=weights.of.shape)
    leaves = np.array([k for k in range(lm.LEAVES) if k < lm.DEEP * lm.WIDTH**2 or k % lm.WIDTH == 0])
    kinds = np.repeat(np.array([[5], [77], [1234]], dtype=np.uint64), len(leaves), axis=1)
    assert np.exp(lm.log_probabilities(weights, kinds, leaves)).sum() == pytest.approx(1, abs=1e-4)
    kinds, _ = lm.features(lm.Codes({}).of([b"a", b"b", b"a", b"c"]), np.array([3, 1]))
    assert kinds[:, 0].tolist() == kinds[:, 3].tolist()  # either begins a document


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(2)
    codes = lm.Codes({w: 256 * k + 7 for k, w in enumerate([b"a", b"b", b"c"])})
    found, lengths = lm.joined([[[b"a", b"b", b"c"][k % 3] for k in range(300)]], codes)
    kinds, leaf = lm.features(found, lengths)
    weights, seen = lm.Weights(4096, lm.biases(np.ones(lm.LEAVES))), np.zeros((lm.LEVELS, 3, 4096), dtype=np.float32)
    before = lm.log_probabilities(weights, kinds, leaf).sum()
    for _ in range(30):
        lm.train(weights, seen, kinds, leaf)
    assert lm.log_probabilities(weights, kinds, leaf).sum() > before / 4 and rng is not None


def test_leaves_of_a_column(spark):
    own = lm.own_leaves([b"the"])
    words = [b"a", b"ab", b"abc", b"abcd", "\u00e9t\u00e9".encode(), b"x" * 500]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "token binary").select("token", lm.leaf_column().alias("c")).collect()
    assert {bytes(r.token): r.c for r in got} == {w: lm.leaf_of(w, own) for w in words}
    assert [c & 4095 for c in lm.Codes(own).of([b"the", *words]).tolist()] == [lm.leaf_of(w, own) for w in [b"the", *words]]
    many = lm.own_leaves([b"w%d" % k for k in range(5000)])
    assert len(set(many.values())) == len(many) == lm.FREQUENT + lm.DEEP_WORDS and max(many.values()) < lm.LEAVES - lm.WIDTH * lm.SHARED
