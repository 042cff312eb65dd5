import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import toxicity


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = toxicity.judge(docs, labels.where(half)).join(labels.where(~half), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.rejected for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.severity <= 1 and 0 <= r.p_toxic <= 1 for r in rows)


def graded(n, seed):
    """Texts whose insults come more often the higher the grade, and in inflected forms that none of them share whole."""
    pick = random.Random(seed)
    out = []
    for k in range(n):
        grade = k % 4
        words = [pick.choice("calm river under stone the of and light walks home".split()) for _ in range(60)]
        for _ in range(3 * grade):
            words[pick.randrange(60)] = "scoundrel" + "".join(pick.choice("abcdefgh") for _ in range(4))
        out.append((k, " ".join(words), grade))
    return out


def test_grades_are_found_and_scores_equal_plain_ones(spark):
    rows = graded(800, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, true int")
    labels = docs.where("doc_id < 600").select("doc_id", F.col("true").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert model.levels == [0, 1, 2, 3] and all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in model.score(docs.select("doc_id", "text")).collect()}
    # brute force: occurrences of every term, the cumulative logits, and their differences
    for i, text, _ in rows[580:]:
        words = text.lower().split()
        z = 0.0
        for term, w in model.terms.items():
            t = term.decode()
            n = sum(x.startswith(t[:-1]) and len(x) > len(t) - 1 for x in words) if t.endswith("*") else words.count(t)
            z += w * math.log1p(n * toxicity.PER / (len(words) + toxicity.MORE))
        above = [1.0, *(1 / (1 + math.exp(t - z)) for t in model.thresholds), 0.0]
        p = [a - b for a, b in zip(above, above[1:], strict=False)]
        assert got[i].p_toxic == pytest.approx(above[1]) and got[i].severity == pytest.approx(sum(k * x for k, x in enumerate(p))) and got[i].grade == p.index(max(p))
    held = [(got[i], g) for i, _, g in rows[600:]]
    assert sum(r.grade == g for r, g in held) >= 0.7 * len(held)
    assert np.corrcoef([r.severity for r, _ in held], [g for _, g in held])[0, 1] > 0.9


def test_planted(spark):
    docs = [(k, f"quiet words number {k} here " * 3) for k in range(300)] + [(k, f"you moron fool number {k} " + "moron " * (k % 5)) for k in range(300, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k >= 300)) for k, _ in docs if k % 2], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.judge(frame, labels).collect() if r.rejected} == set(range(300, 400))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(odd, labels).count() == odd.count()
    assert toxicity.judge(empty, labels).count() == 0
    assert not any(r.rejected for r in toxicity.judge(odd, labels.limit(0)).collect())
    clashing = odd.withColumns({c: F.lit(1) for c in ("terms", "x", "z", "severity", "p_toxic", "grade")})
    got = toxicity.judge(clashing, labels, ("text", "lang", "terms", "x", "z", "severity", "grade"))
    assert got.count() == odd.count() and got.columns == ["doc_id", "text", "lang", "terms", "x", "z", "p_toxic", "severity", "grade", "rejected"]


def test_fit_follows_the_likelihood():
    pick = np.random.default_rng(3)
    rows = [(int(np.digitize(k % 5 + pick.normal(), [1, 3])), [0, 1 + k % 2], [float(k % 5), 1.0]) for k in range(400)]

    def loss(w, t):
        z = [sum(w[j] * x for j, x in zip(r[1], r[2], strict=True)) for r in rows]
        above = lambda g, v: 1.0 if g < 0 else 0.0 if g >= len(t) else 1 / (1 + math.exp(t[g] - v))
        return -sum(math.log(max(above(r[0] - 1, v) - above(r[0], v), 1e-12)) for r, v in zip(rows, z, strict=True)) / len(rows) + toxicity.PENALTY * np.abs(w).sum()

    w, t = toxicity.fit(rows, 3, 3)
    assert all(np.diff(t) > 0)
    best = loss(w, t)
    for step in (0.1, -0.1):
        assert loss(w + np.array([step, 0, 0]), t) > best - 1e-4 and loss(w, t + np.array([0, step])) > best - 1e-4
