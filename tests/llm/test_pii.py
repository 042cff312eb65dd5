import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def spans(rows):
    return Counter((r.doc_id, tuple((s.kind, s.first, s.last) for s in r.spans if s.kind != "term")) for r in rows)


TEXTS = ["a@b.c_d@e.f x..y@z.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3", "4111 1111-1111 1111, 4111111111111112 378282246310005", "+1 (523) 555-1055. +4 4( ++49 170 1234567 -", "é漢😀 a@b.cc 😀1.2.3.4", "5" * 30_000, "a" * 60_000 + "@", "+1" + " " * 50_000, "1 " * 30_000, "x@" * 20_000, "1.2.3.4 " * 2_000]


def test_base_against_plain_code(spark, odd, empty):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for docs in (frame, odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        assert spans(pii.find(docs).collect()) == Counter((r.doc_id, tuple(plain(r.text))) for r in docs.collect())
    assert pii.find(empty).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.@a-_ +()é", max_size=40), min_size=60, max_size=60))
def test_base_on_random_texts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = frame.select("doc_id", pii.base_spans(frame.text).alias("spans")).collect()
    assert spans(got) == Counter((k, tuple(plain(t))) for k, t in enumerate(texts))


def test_terms_and_redaction(spark):
    docs = [(k, f"note {k} from Zanzibar{'.' * (k % 2)} about bob@x.org item{k} and more plain words{k} here") for k in range(5)]
    docs += [(k, f"plain note from about {k} and more words here") for k in range(5, 30)]
    docs += [(40, "Zanzibar bob@x.org")]
    f = pii.find(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: r for r in f.collect()}
    assert {s.found.strip(".").lower() for r in rows.values() for s in r.spans if s.kind == "term"} == {"zanzibar"}
    assert [s.kind for s in rows[40].spans] == ["email", "term"]
    out = {r.doc_id: r.t for r in f.select("doc_id", pii.redacted(f.text, f.spans).alias("t")).collect()}
    assert out[40] == "[TERM] [EMAIL]" and out[7] == docs[7][1]
    assert "bob" not in out[0] and "item0" in out[0]


def test_copies_are_one_surrounding(spark):
    docs = [(k, "same words with Zanzibar and bob@x.org again") for k in range(9)]
    assert not any(s.kind == "term" for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans)


def terms(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, s.found) for r in pii.find(frame).collect() for s in r.spans if s.kind == "term"}


OTHERS = [f"other text {k} of no account" for k in range(60)]


def test_share_is_of_distinct_texts(spark):
    near = [f"a{k} b{k} Zanzibar bob@x.org c{k}" for k in range(3)]
    assert terms(spark, near + near[:1] * 9 + OTHERS) == {(k, "Zanzibar") for k in range(12)}  # copies hide nothing
    once = " ".join(["Zanzibar bob@x.org" + "".join(f" w{k}{j}" for j in range(20)) for k in range(3)])
    assert not terms(spark, [once] + [f"Zanzibar again {k}" for k in range(5)] + OTHERS)  # 1 of 6 texts


def test_terms_of_two_surroundings_in_every_document(spark):
    texts = ["a1 b1 Li bob@x.org c1", "a2 b2 Li bob@x.org c2", "c3 Li, elsewhere"]
    assert terms(spark, texts[:2] + OTHERS) == {(0, "Li"), (1, "Li")}
    near = [f"a{k} b{k} Li bob@x.org c{k}" for k in range(6)]
    assert (6, "Li,") in terms(spark, [*near, texts[2], *OTHERS])


def test_clashing_columns(spark, odd):
    from pyspark.sql import functions as F

    docs = odd.withColumns({c: F.lit(c) for c in ("spans", "_a", "_b", "_kept", "all", "terms", "of", "term")})
    got = pii.find(docs, ("_a", "_kept", "spans", "text", "term", "all"))
    assert got.columns == ["doc_id", "text", "_a", "_kept", "term", "all", "spans"]
    assert {tuple(r) for r in got.select("_a", "_kept", "term", "all").collect()} == {("_a", "_kept", "term", "all")}
    assert spans(got.collect()) == spans(pii.find(odd).collect())


def test_many_findings_take_linear_time(spark):
    import time

    text = " ".join(f"a{k}@b.org" for k in range(32_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = frame.select(pii.base_spans(frame.text).alias("spans")).collect()[0].spans
    assert [(s.kind, s.first, s.last) for s in got] == plain(text)
    assert time.time() - began < 20


def test_words_near_an_entity_however_long(spark):
    """The words beside an entity count although hundreds of characters stand between."""
    wide = [f"Zanzibar{' ' * 5000}{'y' * 900}{k} bob@x.org and{' ' * 400}more{k}" for k in range(3)]
    assert "Zanzibar" in {t for _, t in terms(spark, wide + OTHERS)}
