import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, i long, part int, place int, h string"


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest(*(field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain(rows):
    """What the query should give, made level by level."""
    leaves, by = [leaf(r, r.text) for r in rows], {}
    for k, r in enumerate(rows):
        by.setdefault(r.source, []).append(k)
    proofs, places = [[] for _ in rows], [[] for _ in rows]

    def tree(nodes):
        while len(nodes) > 1:
            above = []
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for j, (_, members) in enumerate(run):
                    for k in members:
                        proofs[k] += [d for q, (d, _) in enumerate(run) if q != j]
                        places[k].append((j, len(run)))
                above.append((digest(*(d for d, _ in run)), [k for _, x in run for k in x]))
            nodes = above
        return nodes[0]

    tops, subroot = [], {}
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        order = sorted(by[source], key=lambda k: (rows[k].doc_id is not None, rows[k].doc_id or 0, leaves[k]))
        tops.append(tree([(leaves[k], [k]) for k in order]))
        subroot |= dict.fromkeys(tops[-1][1], tops[-1][0])
    root, out = tree(tops)[0] if rows else "", []
    for k, r in enumerate(rows):
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        now = leaf(r, r.text and r.text.translate({c: c + 32 for c in range(65, 91)})) if hit else leaves[k]
        at = 0
        for j, n in places[k]:
            run = proofs[k][at : at + n - 1]
            now, at = digest(*run[:j], now, *run[j:]), at + n - 1
        out.append((r.doc_id, leaves[k], subroot[k], root, digest(*proofs[k]), now, now == root))
    return sorted(out, key=repr)


def found(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in m.op13_merkle_manifest(spark, str(folder)).collect()), key=repr)


def row(k, source, text="A text"):
    return (k, text, "en", source, None, 0, 0, 0, 0, "h")


@pytest.mark.parametrize("case", ["sources", "one source", "lone", "deep"])
def test_plain(spark, tmp_path, case):
    rows = {
        # null, empty, non-ASCII and lone sources, 20 of them, so that the top tree has two levels
        "sources": [row(k, f"s{k % 17}") for k in range(60)] + [row(k, None, None) for k in range(20)] + [row(7, ""), row(8, "é"), row(9, "\U0001f600"), row(None, "s1"), row(3, "s3"), row(3, "s3"), row(3, "s3", "Ä Ö x" * 3000)],
        "one source": [row(k, "s", "") for k in range(17)],
        "lone": [row(5, None, "UP")],
        "deep": [row(k, "hot") for k in range(5000)] + [row(k, "cold") for k in range(257)],
    }[case]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(spark, docs, tmp_path) == plain(docs.collect())


def test_odd_and_empty(spark, odd, empty, tmp_path):
    assert found(spark, odd, tmp_path / "odd") == plain(odd.collect())
    assert found(spark, empty, tmp_path / "empty") == []


def test_copies_of_ancestors_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "MOST_A_COPY", 8)
    docs = spark.createDataFrame([row(k, "hot") for k in range(5000)] + [row(1, "b")], SCHEMA)
    assert found(spark, docs, tmp_path) == plain(docs.collect())


def test_proofs_verify_and_tampering_shows(spark):
    docs = spark.createDataFrame([row(k, "a") for k in range(40)], SCHEMA)
    got = m.manifest(docs, (F.col("doc_id") == 3, lambda t: F.concat(t, F.lit("!"))))
    root = m.folded(F.col("leaf_now"), F.col("proof"), F.col("steps"))
    bad = got.where(root != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [3]
    assert got.where(m.folded(F.col("leaf"), F.col("proof"), F.col("steps")) != F.col("root")).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert sorted((tuple(r) for r in m.op13_merkle_manifest(spark, "/root/testdata/sf0.01").collect()), key=repr) == plain(rows)
