from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNT = token_counts.pieces_of(PATH)


def want(rows):
    return Counter((r.doc_id, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 4096) for r in rows)


def test_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for d in (odd, docs):
        assert Counter(tuple(r) for r in token_counts.count_tokens(d, PATH).collect()) == want(d.collect())
    assert token_counts.count_tokens(empty, PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t▁aEé漢.,<s>1-　")) | st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60))
def test_sum_of_pre_tokens(text):
    assert sum(COUNT(token_counts.pre_tokens(text.encode()))) == len(LIBRARY.encode(text))
