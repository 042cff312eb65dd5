"""Quality by weak supervision: rules vote to keep or drop a text, or abstain; expectation-maximisation estimates how
each rule votes on good and on bad texts; a text's posterior probability of being good decides.

The driver sees only how often each combination of votes occurs: 3 ** len(RULES) rows at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, small_batches, table

WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
KEEP_AT = 0.5
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"

#: name: from what value on it drops; below what value it keeps; between them it abstains. The values are shares.
RULES = {
    "symbols": (0.05, 0.01),
    "repeated_words": (0.3, 0.05),
    "repeated_lines": (0.3, 0.05),
    "capital_words": (0.4, 0.1),
    "common_word": (0.35, 0.2),
    "ended_words": (0.5, 0.35),
    "odd_word_length": (1.0, 0.5),
    "shortness": (1.0, 0.4),
}
#: How a rule is taken to vote (drop, abstain, keep) on good and on bad texts before any are seen, and the weight of
#: this belief, as a share of the texts. It names the two classes: the bad one is the one that rules vote down.
BELIEF = np.array([[0.01, 0.09, 0.90], [0.25, 0.25, 0.50]])
BELIEF_SHARE, GOOD_SHARE = 0.02, 0.85
ROUNDS = 100


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if not same.any():
        return 0
    maybe = order[np.r_[same, False] | np.r_[False, same]]
    windows = [tuple(words[i : i + window]) for i in maybe.tolist()]  # equal hashes are not yet equal words
    times = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(maybe.tolist(), windows, strict=True):
        if times[w] > 1:
            covered[i] += 1
            covered[min(i + window, len(words))] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measures(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the value of each rule."""
    words, string = text.split(), text.decode("utf-8", "replace")
    chars = len(string) - sum(map(string.count, SPACES))
    symbols = sum(map(string.count, SYMBOLS))
    seen: set[str] = set()
    lines = doubles = 0
    for line in string.split("\n"):
        if line.strip(SPACES):
            lines += 1
            doubles += line in seen
            seen.add(line)
    n = len(words)
    repeats = repeated_words(words)
    if not n:
        return (0, chars, symbols, doubles, 0), [1.0] * len(RULES)
    mean = chars / n
    ended = sum(w[-1:] in b".!?" for w in words)
    capital = sum(w.isupper() and len(w) > 1 for w in string.split())
    common = Counter(words).most_common(1)[0][1] / n if n >= MIN_WORDS else 0.0
    values = [symbols / max(chars, 1), repeats / n, doubles / max(lines, 1), capital / n, common, ended / n, max(mean / 15, 2 / mean), 10 / n]
    return (n, chars, symbols, doubles, repeats), values


def votes(values: list[float]) -> list[int]:
    """-1 drops, 1 keeps, 0 abstains."""
    return [-1 if v >= high else 1 if v < low else 0 for v, (high, low) in zip(values, RULES.values(), strict=True)]


def measured(docs: DataFrame) -> DataFrame:
    """The measures and votes of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        for batch in batches:
            found = [measures(t) for t in utf8(batch.column(1))]
            columns = list(zip(*(m for m, _ in found), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([votes(v) for _, v in found], pa.list_(pa.int8()))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes array<tinyint>")


def estimate(combinations: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """How each rule votes on good and bad texts (rules x 2 x 3 votes), and the share of good ones."""
    n, rules = counts.sum(), combinations.shape[1]
    belief = np.broadcast_to(BELIEF, (rules, 2, 3))
    theta, good = belief.copy(), GOOD_SHARE
    weight = BELIEF_SHARE * n + 1
    for _ in range(ROUNDS):
        both = np.log([good, 1 - good]) + sum(np.log(theta[j][:, combinations[:, j] + 1]).T for j in range(rules))
        both = np.exp(both - both.max(axis=1, keepdims=True))
        share = both / both.sum(axis=1, keepdims=True) * counts[:, None]
        good_now = (share[:, 0].sum() + GOOD_SHARE * weight) / (n + weight)
        theta_now = np.stack([np.stack([np.bincount(combinations[:, j] + 1, weights=share[:, y], minlength=3) for y in (0, 1)]) for j in range(rules)]) + weight * belief
        theta_now = theta_now / theta_now.sum(axis=2, keepdims=True)
        done = np.abs(theta_now - theta).max() < 1e-6
        theta, good = theta_now, good_now
        if done:
            break
    return theta, float(good)


def judge(docs: DataFrame) -> DataFrame:
    """Judges every row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than MIN_WORDS
    words, or over MAX_REPEATED % of them in repeated windows), votes, quality (posterior probability of being good)
    and kept (not base_failed, and quality of KEEP_AT or more). A null or empty text has no words and fails; rows
    with an equal or null doc_id are judged each by itself; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    found = cut(measured(docs), "quality")
    rows = found.groupBy("votes").agg(F.count("*").alias("n")).collect()
    log_ratio = np.zeros((len(RULES), 3))
    prior = 0.0
    if rows:
        theta, good = estimate(np.array([r["votes"] for r in rows]), np.array([r["n"] for r in rows], dtype=float))
        log_ratio, prior = np.log(theta[:, 0] / theta[:, 1]), float(np.log(good / (1 - good)))
    weight = F.array(*(F.array(*map(F.lit, map(float, r))) for r in log_ratio))
    odds = F.aggregate(F.zip_with("votes", weight, lambda v, w: F.element_at(w, v.cast("int") + 2)), F.lit(prior), lambda a, x: a + x)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return found.select("*", failed.alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("votes")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
