import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strata.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_odd_rows_and_small_capacity(spark, odd, empty):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity in (7, 4096):
        check(packing.pack(odd, PATH, capacity).collect(), texts, capacity)
    assert packing.pack(empty, PATH).count() == 0
    ids = packing.pack(odd, PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in ids)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def fewest(items, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                put(i + 1, bins)
                bins[j] -= items[i]
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def test_plan_against_all_ways():
    random.seed(3)
    for _ in range(300):
        capacity = random.choice([10, 20, 37])
        items = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        stock = packing._Stock(Counter(items))
        _, fixed = packing.reduce_by_dominance(stock, capacity)
        rest = [x for x, n in stock.left.items() for _ in range(n)]
        least = fewest(items, capacity)
        assert fixed + fewest(sorted(rest, reverse=True), capacity) == least  # what was fixed belongs to an optimum
        runs, bins = packing.plan(Counter(items), capacity)
        assert sum(r[2] for r in runs) == len(items)
        assert least <= bins <= least + 1
