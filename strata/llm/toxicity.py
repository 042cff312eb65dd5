"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text's severity grade y follows P(y <= k) = 1 / (1 + exp(w.x - t_k)): one weight for each term, shared by all
thresholds, and thresholds in order. Terms are words and their stems (beginnings of STEMS characters, so that inflected
and compound forms count together); x holds log(1 + occurrences in PER words) of the TERMS terms whose presence tells
most about the grades. Grades are those of the labels, as many as there are. The model is fitted on LABELLED labelled
documents at most, chosen by a hash of their id; held-out folds of them choose the probability from which on a text is
rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.decontamination import words_of
from strata.llm.shared import cut, kept_columns, small_batches, spread_sample, table

LABELLED, TERMS, TERM_BYTES = 20_000, 1_000, 64
STEMS = range(4, 9)
#: Labelled texts that a term must be in.
SUPPORT = 3
#: Occurrences are taken per so many words; so many more words are added to each text, so that short ones don't stand out.
PER, MORE = 200, 100
PENALTY, STEPS, STEP = 0.002, 400, 0.05
#: The share of clean held-out texts that may be rejected, and by how much the recall may fall below the best such one.
SPARE, NEAR_BEST, FOLDS, FOLD_STEPS = 0.005, 0.005, 3, 150
KNOWN_WORDS = 500_000


def terms_of(word: bytes) -> list[bytes]:
    """A word, and its stems, marked by *."""
    if len(word) > TERM_BYTES:
        return []
    text = word.decode("utf-8", "replace")
    return [word, *(text[:k].encode() + b"*" for k in STEMS if k < len(text))]


class Known(dict):
    """The numbers of a word's terms, worked out when it is first met."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(k for t in terms_of(word) if (k := self.terms.get(t)) is not None)
        if len(self) < KNOWN_WORDS:
            self[word] = found
        return found


def occurrences(text: bytes, known: Known) -> dict[int, float]:
    """x of a text: number of the term, and log(1 + its occurrences in PER words)."""
    words = words_of(text)
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for k in known[word]:
            found[k] += n
    return {k: float(np.log1p(n * PER / (len(words) + MORE))) for k, n in found.items()}


def telling_terms(texts: DataFrame) -> DataFrame:
    """texts: text, grade. For each term: clean and toxic texts that it is in, and the log-likelihood ratio."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        sides: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, grade in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                sides[grade > 0].update({t for w in set(words_of(text)) for t in terms_of(w)})
        terms = list(sides[0] | sides[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([s[t] for t in terms], pa.int64()) for s in sides)], names=["term", "clean", "toxic"])

    total = texts.agg(F.count(F.when(F.col("grade") == 0, 1)).alias("c"), F.count(F.when(F.col("grade") > 0, 1)).alias("t")).collect()[0]
    n = total["c"] + total["t"]
    terms = texts.select("text", "grade").mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    df = F.col("clean") + F.col("toxic")
    part = lambda seen, side: F.when(seen > 0, seen * F.log(seen * n / (df * side))).otherwise(0.0)
    gain = 2 * (part(F.col("toxic"), total["t"]) + part(F.col("clean"), total["c"]))
    return terms.where((df >= SUPPORT) & (F.col("toxic") * n > df * total["t"])).withColumn("gain", gain)


def features(texts: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """grade, terms and x of each of the texts (text, grade)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        known = Known(terms)
        for batch in batches:
            found = [occurrences(t, known) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.float64()))], names=["grade", "terms", "x"])

    return texts.select("text", "grade").mapInArrow(run, "grade int, terms array<int>, x array<double>")


def fit(rows: list[tuple[int, list[int], list[float]]], n_terms: int, grades: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from (grade from 0 on, terms, x), by proximal gradient steps; few weights stay."""
    y = np.array([r[0] for r in rows], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    term = np.array([t for r in rows for t in r[1]], dtype=np.int64)
    x = np.array([t for r in rows for t in r[2]], dtype=np.float64)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    # thresholds are the first one and the logarithms of the gaps between them, so that they stay in order
    free = np.r_[cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))]
    w = np.zeros(n_terms)
    m, v = np.zeros(n_terms + len(free)), np.zeros(n_terms + len(free))
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[free[:1], np.exp(free[1:])])
        z = np.bincount(row, weights=w[term] * x, minlength=len(y))
        c = 1 / (1 + np.exp(np.clip(z[:, None] - t, -30, 30)))
        c = np.c_[np.zeros(len(y)), c, np.ones(len(y))]
        p = np.maximum(c[np.arange(len(y)), y + 1] - c[np.arange(len(y)), y], 1e-9)
        d = c * (1 - c)  # by threshold
        up, low = d[np.arange(len(y)), y + 1], d[np.arange(len(y)), y]
        g_w = np.bincount(term, weights=((up - low) / p)[row] * x, minlength=n_terms) / len(y)
        g_t = np.array([np.sum(np.where(y == k, -d[:, k + 1] / p, 0) + np.where(y == k + 1, d[:, k + 1] / p, 0)) for k in range(grades - 1)]) / len(y)
        g_f = np.r_[g_t.sum(), np.exp(free[1:]) * np.cumsum(g_t[::-1])[::-1][1:]]
        g = np.r_[g_w, g_f]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = STEP / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
        new = np.r_[w, free] - size * m / (1 - 0.9**step)
        w, free = new[:n_terms], new[n_terms:]
        w = np.sign(w) * np.maximum(np.abs(w) - size[:n_terms] * PENALTY, 0)
    return w, np.cumsum(np.r_[free[:1], np.exp(free[1:])])


def probability(rows: list[tuple[int, list[int], list[float]]], w: np.ndarray, threshold: float) -> np.ndarray:
    """P(grade above 0) of each row."""
    z = np.array([sum(w[t] * x for t, x in zip(r[1], r[2], strict=True)) for r in rows])
    return 1 / (1 + np.exp(np.clip(threshold - z, -30, 30)))


def rejection(rows: list[tuple[int, list[int], list[float]]], n_terms: int, grades: int) -> float:
    """The probability from which on texts are rejected: held out fold by fold, no more than SPARE of the clean ones
    reach it, and about as many toxic ones as any such probability allows do; it lies midway (in log odds) between the
    lowest and the highest of that kind."""
    fold = np.arange(len(rows)) % FOLDS
    p, toxic = np.zeros(len(rows)), np.array([r[0] > 0 for r in rows])
    for k in range(FOLDS):
        w, thresholds = fit([r for r, f in zip(rows, fold, strict=True) if f != k], n_terms, grades, FOLD_STEPS)
        p[fold == k] = probability([r for r, f in zip(rows, fold, strict=True) if f == k], w, thresholds[0])
    clean = np.sort(p[~toxic])[::-1]
    low = min(clean[int(SPARE * len(clean))] + 1e-9, 1 - 1e-9) if len(clean) else 1e-9
    caught = np.sort(p[toxic & (p >= low)])
    if not len(caught):
        return 0.5
    high = caught[int(NEAR_BEST * toxic.sum())] if len(caught) > int(NEAR_BEST * toxic.sum()) else caught[-1]
    odds = [np.log(x / (1 - x)) for x in (low, max(low, min(high, 1 - 1e-9)))]
    return float(1 / (1 + np.exp(-sum(odds) / 2)))


class Model:
    """Terms with their weights, thresholds, the grades that they part, and the probability that rejects."""

    def __init__(self, terms: dict[bytes, float], thresholds: list[float], levels: list[int], reject_at: float):
        self.terms, self.thresholds, self.levels, self.reject_at = terms, thresholds, levels, reject_at

    def score(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """docs, without text unless with_text, with p_toxic (P of any grade above 0), severity (expected grade) and grade (likeliest)."""
        names, weights = list(self.terms), np.array(list(self.terms.values()))
        rest = [c for c in docs.columns if with_text or c != "text"]

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            from strata.llm.shared import utf8

            known = Known({t: k for k, t in enumerate(names)})
            for batch in batches:
                z = [sum(weights[k] * x for k, x in occurrences(t, known).items()) for t in utf8(batch.column(batch.schema.names.index("text")))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), pa.array(z, pa.float64())], names=[*rest, "_strata_z"])

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in rest)
        above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_strata_z"))) for t in self.thresholds]
        each = [a - b for a, b in zip([F.lit(1.0), *above], [*above, F.lit(0.0)], strict=True)]
        severity = sum((p * float(g) for p, g in zip(each, self.levels, strict=True)), F.lit(0.0))
        likeliest = F.element_at(F.array(*map(F.lit, self.levels)), F.array_position(F.array(*each), F.array_max(F.array(*each))).cast("int"))
        found = docs.mapInArrow(run, f"{kinds}_strata_z double")
        return found.select(*rest, above[0].alias("p_toxic"), severity.alias("severity"), likeliest.cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs (doc_id, text) with labels (doc_id, toxic: a grade, 0 for clean).

    Labels without id or grade are left out, and grades below 0 are 0; of several labels of a document the highest
    counts. Without labels of two grades no text is toxic.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col("toxic").cast("int"), F.lit(0)).alias("grade"), F.col("toxic").cast("int").alias("given")).where(F.col("doc_id").isNotNull() & F.col("given").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    some = spread_sample(labels, "doc_id", LABELLED, labels.count())
    # LABELLED rows of two numbers; broadcast as such
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id"), "labelled")
    levels = sorted(r["grade"] for r in texts.select("grade").distinct().limit(1_000).collect())
    if len(levels) < 2 or levels[0] > 0:
        return Model({}, [30.0], [0, max(levels, default=1) or 1], 0.5)
    # ties by the term itself, so that every run takes the same ones
    terms = {bytes(r["term"]): k for k, r in enumerate(telling_terms(texts).orderBy(F.desc("gain"), "term").limit(TERMS).collect())}
    rows = sorted((levels.index(r["grade"]), *map(list, zip(*sorted(zip(r["terms"], r["x"], strict=True)), strict=True))) if r["terms"] else (levels.index(r["grade"]), [], []) for r in features(texts, terms).collect())
    # rows come in any order; sorted and dealt by a fixed seed, folds are the same on every run
    rows = [rows[k] for k in np.random.default_rng(7).permutation(len(rows))]
    w, thresholds = fit(rows, len(terms), len(levels))
    return Model({t: float(w[k]) for t, k in terms.items() if w[k]}, thresholds.tolist(), levels, rejection(rows, len(terms), len(levels)))


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Grades every row of docs by a model trained on those with labels.

    Returns doc_id, the columns of docs named in `keep` (but those of the same name as one of these results), p_toxic,
    severity (expected grade), grade (likeliest) and rejected (p_toxic of the model's reject_at or more). A null or empty
    text has no terms; rows with an equal or null doc_id are graded each by itself; an empty table gives an empty
    result, and without labels of two grades nothing is rejected.
    """
    small_batches(docs.sparkSession)
    keep = kept_columns(keep, ("doc_id", "p_toxic", "severity", "grade", "rejected"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c != "text"))
    model = train(docs, labels)
    return model.score(docs, "text" in keep).withColumn("rejected", F.col("p_toxic") >= model.reject_at)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
