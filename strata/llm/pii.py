"""Personal data: patterns, and terms that give a person away; DataFrame operations only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Besides, the corpus shows which words give a
protected entity (one such address or number) away. Of the distinct texts with a word, P(entity | word) is the share of
those in which it stands near the entity. What the word tells of the entity is log(P(entity | word) / P(entity)), in
shares of all there is to tell, log(1 / P(entity)); k different surroundings are believed by k / (k + 1). Words with
a share of DISCLOSURE or more that tell INFORMED or more are findings too (kind "term"), wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import cut, kept_columns, sifted, table

#: The patterns of the contract, with possessive repeats: nothing follows that they could give way to. A local part
#: begins where its run of characters does, or where the last finding ended; so does the first number of an IP address.
#: This changes no finding and keeps the search linear in long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words on either side of an entity that count as near it, share of texts and share of what there is to tell that disclose.
NEAR, DISCLOSURE, INFORMED = 8, 0.5, 0.6
WORD = r"[^\x20\x09-\x0D]+"
#: Candidates that are sent to all tasks; with more, the words of all texts are dealt out by word and meet them there.
SENT = 500_000
#: Findings of a text that are placed together.
BLOCK = 256
#: Characters on either side of an entity in which the nearest words are looked for; if there are too few, in the next number of them, and at last in all.
REACHES = (320, 2_560, 20_480)

SPANS = "array<struct<kind: string, first: int, last: int, found: string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= F.when(F.regexp_replace(p, "^0+", "") <= "255", 3).otherwise(2))
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _placed(text: Column, pattern: str) -> Column:
    """All findings in turn with their places: what stands between two findings tells where the next one begins.

    Lengths are added up within blocks of BLOCK findings, and blocks are moved by those before them, since an array that grows by one
    finding is copied each time."""
    kind = "array<struct<first: int, last: int, found: string>>"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + x["gap"]
        last = first + F.length(x["found"])
        return F.struct(last.alias("at"), F.concat(a["out"], F.array(F.struct(first.alias("first"), last.alias("last"), x["found"].alias("found")))).alias("out"))

    def moved(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<by: int, out: {kind}>>").alias("out"))
        after = F.aggregate(blocks, begin, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("by"), x["out"].alias("out")))).alias("out")), lambda a: a["out"])
        return F.flatten(F.transform(after, lambda x: F.transform(x["out"], lambda s: F.struct((s["first"] + x["by"]).alias("first"), (s["last"] + x["by"]).alias("last"), s["found"].alias("found")))))

    def placed(pairs: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * BLOCK + 1, BLOCK), zero, step))
        return F.when(F.size(pairs) == 0, F.array().cast(kind)).otherwise(moved(each))

    # an array of (gap, finding); each begins after the lengths of all before it
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda x, g: F.struct(x.alias("found"), F.length(g).alias("gap"))))
    return _let(pairs, placed)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["found"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _named(kind: str, placed: Column) -> Column:
    return F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["first"].alias("first"), s["last"].alias("last"), s["found"].alias("found")))


def base_spans(text: Column) -> Column:
    """The spans of all patterns, by kind and then by place; places are code points, the last one excluded."""
    none = F.array().cast(SPANS)
    parts = []
    for kind in KINDS:
        # most texts lack the sign that a finding needs; they are not searched further
        needed = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}[kind]
        parts.append(F.when(needed, _named(kind, F.filter(_placed(text, PATTERNS[kind]), _check(kind)))).otherwise(none))
    return F.concat(*parts)


def _plain(word: Column) -> Column:
    """A word without the punctuation around it, in lower case."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _entity(s: Column) -> Column:
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["found"])).otherwise(F.lower(s["found"])))


def _words(text: Column) -> Column:
    """The different plain words of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))), _plain))


def _nearest(text: Column, s: Column, before: bool) -> Column:
    """The NEAR words that stand nearest to a span on one side. Part of the text will do if it has a word more, as its outermost may be cut."""
    room = s["first"] if before else F.length(text) - s["last"]

    def within(reach: int | None, wider: Column | None) -> Column:
        length = room if reach is None else F.least(room, F.lit(reach))
        part = F.substr(text, s["first"] - length + 1, length) if before else F.substr(text, s["last"] + 1, length)
        words = F.regexp_extract_all(part, F.lit(WORD), F.lit(0))
        if wider is None:
            return _first(words)
        return _let(words, lambda w: F.when((room <= reach) | (F.size(w) > NEAR), _first(w)).otherwise(wider))

    def _first(words: Column) -> Column:
        return F.slice(F.reverse(words) if before else words, 1, NEAR)

    out = within(None, None)
    for reach in reversed(REACHES):
        out = within(reach, out)
    return out


def disclosing_terms(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity and term of the terms that disclose, and the key and term of every row of docs that holds a candidate. docs: the key (_a, _b) and
    text; found: text and spans of the documents with spans.

    Texts are counted once however often they are copied, and so are surroundings. The texts that hold a term are all
    those of docs.
    """
    as_text = F.xxhash64("text").alias("of")
    spans = found.select("text", F.explode("spans").alias("s")).where(F.col("s.kind") != "term")
    text, s = F.col("text"), F.col("s")
    near = spans.select(_entity(s).alias("entity"), as_text, F.array_distinct(F.transform(F.concat(_nearest(text, s, True), _nearest(text, s, False)), _plain)).alias("words"))
    near = cut(near.withColumn("around", F.xxhash64("words")).dropDuplicates(["entity", "of", "around"]), "near")
    # a hot entity's surroundings meet only per term
    each = near.select("entity", "of", "around", F.explode("words").alias("term")).where(~F.col("term").rlike(r"^[\p{N}.:-]*$|@"))
    pairs = each.groupBy("entity", "term").agg(F.count_distinct("of").alias("both"), F.count_distinct("around").alias("k")).where(F.col("k") / (F.col("k") + 1) >= INFORMED)
    # a term's texts are at least those in which it stands near any entity: what has no share of these can't have one of all
    beside = each.groupBy("term").agg(F.count_distinct("of").alias("beside"))
    pairs = cut(pairs.join(beside, "term").where(F.col("both") >= DISCLOSURE * F.col("beside")).drop("beside"), "pairs")
    terms = cut(pairs.select("term").distinct(), "words")
    if terms.count() <= SENT:
        terms = F.broadcast(terms)
    # all words of all texts are looked at once; what is kept are the candidates'
    held = cut(docs.select("_a", "_b", as_text, F.explode(_words(text)).alias("term")).join(terms, "term", "left_semi"), "held")
    every = held.select("of", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    texts = docs.select(as_text).distinct().count()
    of_entity = near.groupBy("entity").agg(F.count_distinct("of").alias("texts"))
    share, own = F.col("both") / F.col("n"), F.col("texts") / F.lit(max(texts, 1))
    told = F.when(own < 1, F.log(share / own) / F.log(1 / own) * F.col("k") / (F.col("k") + 1)).otherwise(0.0)
    chosen = pairs.join(every, "term").join(of_entity, "entity").where((share >= DISCLOSURE) & (told >= INFORMED)).select("entity", "term")
    return chosen, held.select("_a", "_b", "term")


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are ignored) with its findings.

    Returns doc_id, text, the columns of docs named in `keep` (but for those of the names that are returned anyway), and spans (kind, first,
    last, found: by kind as in KINDS, terms last, then by place). A null text stays null and has none, as an empty one; rows with an
    equal or null doc_id are searched each by itself; an empty table gives an empty result.
    """
    keep = kept_columns(keep, ("doc_id", "text", "spans"))
    kept = [F.struct(*(F.col(c) for c in keep)).alias("_kept")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    # equal rows have equal findings, so a row's key is what it holds
    docs = docs.withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.hash("text", "doc_id")})
    found = cut(docs.select("_a", "_b", "text", F.coalesce(base_spans(F.col("text")), F.array().cast(SPANS)).alias("spans")).where(F.size("spans") > 0), "entities")
    terms, held = disclosing_terms(docs, found)
    own = held.join(cut(terms, "terms").select("term").distinct(), "term").groupBy("_a", "_b").agg(F.collect_set("term").alias("terms"))
    base = found.select("_a", "_b", "spans").dropDuplicates(["_a", "_b"])
    info = cut(base.join(own, ["_a", "_b"], "full"), "findings")
    none = F.array().cast(SPANS)
    # most texts hold nothing, and are not shuffled
    some, others = sifted(docs, info.select("_a", "_b"))
    some = some.join(info, ["_a", "_b"], "left").withColumn("spans", F.coalesce("spans", none))
    placed = F.filter(_placed(F.col("text"), WORD), lambda s: F.array_contains(F.col("terms"), _plain(s["found"])) & ~F.exists("spans", lambda b: (b["first"] < s["last"]) & (s["first"] < b["last"])))
    some = some.withColumn("spans", F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", _named("term", placed)))).drop("terms")
    out = some.unionByName(others.withColumn("spans", none))
    return out.select("doc_id", "text", *(F.col(f"_kept.{c}").alias(c) for c in keep), "spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every finding generalised to its kind, as [EMAIL]; findings that overlap become one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["first"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["last"]).alias("at"), F.when(fresh, F.concat(a["out"], F.substr(text, a["at"] + 1, s["first"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text)))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "term")
    number = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(table(spark, sf_dir, "documents")).select("doc_id", *number, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


QUERIES = {"op9_personal_data": op9_personal_data}
ORACLE_SQL: dict[str, str] = {}
