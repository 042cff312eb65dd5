"""Token counts of documents, by pre-token: each distinct pre-token is tokenised once, and a document's count is the
sum over its pre-tokens. No ids are made for a document.

The tokenizer writes a space as U+2581 and puts one before a text. None of its pieces has that sign after another
character, so no piece reaches over such a place: a text falls into pre-tokens there, each a run of spaces and the
run of other characters after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, small_batches, table
from strata.llm.vocabulary import sums, token_counts

LIMIT = 4096
_CHUNK = re.compile(rb" *[^ ]+| +")
_SIGN = "▁".encode()


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without its first space."""
    if not text:
        return []
    if _SIGN in text:
        text = text.replace(_SIGN, b" ")
    words = text.split(b" ")
    return [x[1:] for x in _CHUNK.findall(b" " + text)] if b"" in words else words


def pieces_of(model: str) -> Callable[[list[bytes]], list[int]]:
    """A function from pre-tokens to their numbers of pieces."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    # a lone space is one piece; the library makes none of an empty text
    return lambda tokens: [len(x) or 1 for x in library.encode([t.decode() for t in tokens], num_threads=1)]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text; other columns are ignored).

    A null or empty text has no tokens. Rows with an equal or null doc_id each get a row. An empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = pieces_of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=["token", "n", "pieces"])

    values = cut(token_counts(docs, pre_tokens).mapInArrow(run, "token binary, n long, pieces long"), "pre-tokens")

    def start(place: dict[bytes, int]) -> Callable:
        return lambda texts: [(pre_tokens(t), None, (float(len(t)),)) for t in texts]

    out = sums(docs, start, values, "n", ["pieces"], ["n_bytes"])
    n = F.col("pieces").cast("long")
    return out.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE_SQL: dict[str, str] = {}
