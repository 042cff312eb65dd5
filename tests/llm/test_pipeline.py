import random

import pytest
from test_decontamination import plain as leaks
from test_packing import check
from test_pii import plain as findings

import corpus_pipeline as p
from strata.llm import shared
from strata.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in p.STAGES:
        found = stage(spark, docs, SF).cache()
        out.append((docs, found))
        docs = found
    return out


def test_columns(steps):
    assert all(tuple(out.columns) == p.COLUMNS and out.dtypes == before.dtypes for before, out in steps[:-1])


def test_toxic_documents_go(spark, steps):
    before, after = (f.collect() for f in steps[0])
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bad = lambda t: any(w in t.lower() for w in ("idiot", "moron", "worthless"))
    left = {r.doc_id for r in after}
    assert sum(bad(r.text) for r in after) <= 0.1 * sum(bad(r.text) for r in before)
    labelled = [(r.doc_id in left, toxic[r.doc_id]) for r in before if r.doc_id in toxic]
    assert sum(kept for kept, t in labelled if not t) >= 0.99 * sum(not t for _, t in labelled)
    assert sum(not kept for kept, t in labelled if t) >= 0.8 * sum(t for _, t in labelled)


def test_one_of_each_stays(steps):
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in steps[1])
    words = {i: t.lower().split() for i, t in before.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    by = {}
    for i, s in shingles.items():
        for x in s:
            by.setdefault(x, []).append(i)
    near = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    alike = [(a, b) for a, b in near if like(a, b) >= 0.8]
    assert len(alike) > 20 and sum(a in after and b in after for a, b in alike) <= 0.05 * len(alike)
    near_enough = {i for ab in near if like(*ab) >= 0.5 for i in ab}
    assert all(i in after for i in before if i not in near_enough)


def test_leaks_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in steps[2])
    gone = [i for i in before if i not in after]
    assert all(any(" ".join(t.lower().split()[:6]) in " ".join(before[i].lower().split()) or leaks(before[i], [(k, t)]) for k, t in items) for i in gone)
    assert not any(t.lower() in x.lower() for x in after.values() for _, t in items)


def test_no_personal_data_stays(steps):
    before, after = ({r.doc_id: r for r in f.collect()} for f in steps[3])
    assert before.keys() == after.keys()
    assert not any(findings(r.text) for r in after.values())
    assert all(r.text == before[i].text for i, r in after.items() if not findings(before[i].text))
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_packing(steps):
    before, after = steps[4]
    check(after.collect(), [(r.doc_id, r.text) for r in before.collect()], 4096)
    assert tokenizer_path()


def test_odd_rows(spark, tmp_path):
    random.seed(1)
    rows = [(1, "a b c d e", None, None, None), (1, "a b c d e", "en", "s", 9), (None, "x y", None, "s", 3), (2, None, "en", None, None), (3, "", "en", "s", 0), (4, "w " * 30_000, "en", "s", 60_000)]
    for name, schema, data in (("documents", "doc_id long, text string, lang string, source string, n_chars long", rows), ("labels", "doc_id long, quality int, toxic int", []), ("benchmark", "item_id long, text string", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, None} and sum(r.doc_id == 1 for r in got) == 1


def noise(rng, words):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=15)) for _ in range(words))


def test_texts_without_a_copy_are_not_shuffled(spark, shuffled):
    rng = random.Random(2)
    rows = [(i + 1, noise(rng, 600), "en", "s", 9) for i in range(300)]
    rows += [(1000, rows[7][1], "en", "s", 9), rows[8], (None, "lost", None, None, 4), (None, "lost", None, None, 4), (2000, None, None, None, None)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    assert shuffled(lambda: got.extend(p.keep_one_of_each(spark, docs, SF).collect())) < 1_000_000 < sum(len(r[1] or "") for r in rows) / 2
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(i, t) for i, t, *_ in rows[:300]] + [(-1, "lost"), (2000, "")])


def test_texts_without_personal_data_are_not_shuffled(spark, shuffled):
    rng = random.Random(3)
    rows = [(i + 1, noise(rng, 600), "en", "s", 9) for i in range(300)] + [(1000, "write to a.b@c.org", "en", "s", 18), (None, "or +49 170 1234567", None, None, 18), (2000, None, None, None, None)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    assert shuffled(lambda: got.extend(p.sanitise(spark, docs, SF).collect())) < 1_000_000
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(i, t) for i, t, *_ in rows[:300]] + [(1000, "write to [EMAIL]"), (-1, "or [PHONE]"), (2000, "")])


def test_sifted_loses_no_key(spark, monkeypatch):
    rows = spark.range(5_000).selectExpr("id", "IF(id % 7 = 0, NULL, concat('t', id)) AS t", "-id AS more")
    keys = rows.where("id % 10 = 3").select("id", "t")
    want = {r.id for r in keys.collect()}
    for maps in (shared.BITMAPS, 1):
        monkeypatch.setattr(shared, "BITMAPS", maps)
        some, others = ([r.id for r in f.collect()] for f in shared.sifted(rows, keys))
        assert want <= set(some) and sorted(some + others) == list(range(5_000)) and len(some) < len(want) * 1.3
    some, others = shared.sifted(rows, keys.where("id < 0"))
    assert some.count() == 0 and others.columns == rows.columns and others.count() == 5_000
