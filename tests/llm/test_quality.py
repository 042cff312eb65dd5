import re
from collections import Counter

from strata.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, r, n < 20 or 100 * r > 30 * n


def test_base_against_plain_code(spark, odd, empty):
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
        assert got == Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert quality.judge(empty).count() == 0


def test_verdicts_follow_labels(spark):
    at = "/root/testdata/sf0.1"
    rows = quality.judge(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    n = Counter((r[-2], r.kept) for r in rows if not r.base_failed)
    good = n[1, True] / (n[1, True] + n[1, False])
    bad = n[0, False] / (n[0, True] + n[0, False])
    assert good > 0.9 and bad > 0.4, n
