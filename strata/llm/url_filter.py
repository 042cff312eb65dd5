"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Pages with a known outcome (good or bad) are counted by host, by registered domain and by suffix. From the suffix down,
each level's rate is the mean of a beta distribution whose prior is the level above: its mean, with a strength of so many pages. How
strong the prior of a level is follows from the pages themselves, by the moments of the beta-binomial: the more hosts of one
domain differ beyond what chance explains, the weaker it is. A page is blocked if the upper bound of its host's rate of good pages, a
quantile of the posterior, is below the floor, a low quantile of how the rates of all hosts are spread. Fixed rules go before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import table

#: Verdict and rule: a host and the beginning of a path. The longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Quantiles of the posterior and of the spread of all hosts' rates.
UPPER, LOWER = 0.95, 0.05
#: Pages that a prior is worth at least and at most, and where no two hosts (or domains, or suffixes) can be compared.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 1000.0, 8.0
#: Points of a quantile's grid, and standard deviations that it reaches on both sides of the mean.
GRID, REACH = 400, 8.0
#: A page is bad if it shows fewer words than this, or if more than a share of its characters are symbols.
WORDS, SYMBOL_SHARE = 50, 0.05
#: Suffixes of two labels begin with one of these.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as text; null if none does."""
    fit = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fit = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(fit)
    return fit


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the last but one is a usual second level under a country."""
    last = F.regexp_extract(host, r"([^.]*)$", 1)
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; the whole host where there is none."""
    return F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def outcomes(pages: DataFrame) -> DataFrame:
    """page_id, url and good of every page, judged by what it shows."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    words = F.size(F.filter(F.split(shown, r"\s+"), lambda w: w != ""))
    symbols = F.length(shown) - F.length(F.translate(shown, "#*$%&|<>", ""))
    return pages.select("page_id", "url", ((words >= WORDS) & (symbols < SYMBOL_SHARE * F.length(shown))).alias("good"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def beta_quantile(a: Column, b: Column, level: float) -> Column:
    """The quantile of a beta distribution: the first of GRID equal steps around its mean up to which that share of the density lies."""
    mean = a / (a + b)
    reach = REACH * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    shape = F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0.0), mean - reach).alias("low"), F.least(F.lit(1.0), mean + reach).alias("high"))

    def at(s: Column, k: Column) -> Column:
        return s["low"] + (k + 0.5) * (s["high"] - s["low"]) / GRID

    def steps(s: Column, d: Column, total: Column) -> Column:
        """How many steps end below the level."""
        none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
        return F.aggregate(d, none, lambda t, x: F.struct((t["sum"] + x).alias("sum"), (t["k"] + F.when(t["sum"] + x < level * total, 1).otherwise(0)).alias("k")), lambda t: at(s, t["k"]))

    def density(s: Column) -> Column:
        logs = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: (s["a"] - 1) * F.log(at(s, k)) + (s["b"] - 1) * F.log(1 - at(s, k)))
        shares = _let(logs, lambda v: _let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
        return _let(shares, lambda d: _let(F.aggregate(d, F.lit(0.0), lambda t, x: t + x), lambda total: steps(s, d, total)))

    return _let(shape, density)


def strength(children: DataFrame, parent: str | None, name: str) -> DataFrame:
    """One row: the pages that the prior of children (pages, good) is worth, given their parents' rates. With rates that differ by chance
    alone it is STRONGEST; the share of the variance that is theirs, pooled over parents, gives the rest."""
    sums = [F.sum("pages").alias("n"), F.sum("good").alias("g"), F.count("*").alias("k"), F.sum(F.col("pages") * F.col("pages")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("pages")).alias("gg")]
    each = (children.groupBy(parent) if parent else children.groupBy()).agg(*sums).where("n > 0")
    v = F.col("g") / F.col("n") * (1 - F.col("g") / F.col("n"))
    one = each.agg(F.sum(F.col("gg") - F.col("g") * F.col("g") / F.col("n")).alias("s"), F.sum(v * (F.col("k") - 1)).alias("chance"), F.sum(v * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))).alias("room"))
    share = (F.col("s") - F.col("chance")) / F.col("room")
    kept = F.least(F.lit(1 / (1 + WEAKEST)), F.greatest(F.lit(1 / (1 + STRONGEST)), share))
    return one.select(F.when(F.col("room") > 0, (1 - kept) / kept).otherwise(F.lit(UNKNOWN)).alias(name))


def reputation(judged: DataFrame) -> DataFrame:
    """host, pages, good, mean, bound (the upper one of the posterior) and floor (one value) of every host with judged pages
    (url, good: boolean, null: unknown)."""
    # pages are summed by host before anything else; a host is one row from here on
    hosts = judged.where(F.col("good").isNotNull()).groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count(F.when(F.col("good"), 1)).alias("good"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    add = [F.sum("pages").alias("pages"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *add)
    suffixes = domains.groupBy("suffix").agg(*add)
    # a row each: the rate of all pages, whose own prior is even, and the strengths of the levels
    top = suffixes.agg(((F.sum("good") + 0.5) / (F.sum("pages") + 1)).alias("rate"))
    for frame, parent, name in ((suffixes, None, "of_suffix"), (domains, "suffix", "of_domain"), (hosts, "domain", "of_host"), (hosts, None, "spread")):
        top = top.crossJoin(strength(frame, parent, name))
    top = top.withColumn("floor", beta_quantile(F.col("rate") * F.col("spread"), (1 - F.col("rate")) * F.col("spread"), LOWER))
    shrunk = lambda above, of: (F.col("good") + F.col(above) * F.col(of)) / (F.col("pages") + F.col(of))
    suffixes = suffixes.crossJoin(F.broadcast(top)).select("suffix", shrunk("rate", "of_suffix").alias("above"), "of_domain", "of_host", "floor")
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("above", "of_domain").alias("above"), "of_host", "floor")
    a, b = F.col("good") + F.col("above") * F.col("of_host"), F.col("pages") - F.col("good") + (1 - F.col("above")) * F.col("of_host")
    return hosts.join(domains, "domain").select("host", "pages", "good", (a / (a + b)).alias("mean"), beta_quantile(a, b, UPPER).alias("bound"), "floor")


def judge(pages: DataFrame, judged: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Judges every row of pages (page_id, url) by the rules and by reputation from `judged` (url, good).

    Returns page_id, host, path, rule (null if none fits), verdict ("allow" or "block": the rule's, else by
    reputation), bound and floor. A null url or one without :// has an empty host and path, which is a host like any other.
    Repeated rows and null ids each get a row. A host without judged pages is allowed. Other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for v, r in rules), F.when(F.col("bound") < F.col("floor"), F.lit("block")).otherwise(F.lit("allow")))
    known = reputation(judged).select("host", "bound", "floor")
    return rows.join(known, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("bound", 6).alias("bound"), F.round("floor", 6).alias("floor"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, outcomes(pages))


QUERIES = {"op3_url_filter": op3_url_filter}
_RULES_SQL = "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1]))) + " END"
_VERDICT_SQL = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " ELSE CASE WHEN bound < floor THEN 'block' ELSE 'allow' END END"


def _strength_sql(table: str, parent: str, name: str) -> str:
    by = f"GROUP BY {parent}" if parent else ""
    kept = f"least({1 / (1 + WEAKEST)!r}, greatest({1 / (1 + STRONGEST)!r}, (s - chance) / room))"
    return f"(SELECT CASE WHEN room > 0 THEN (1 - {kept}) / {kept} ELSE {UNKNOWN} END AS {name} FROM (SELECT sum(gg - g * g / n) AS s, sum(g / n * (1 - g / n) * (k - 1)) AS chance, sum(g / n * (1 - g / n) * (n - nn / n - (k - 1))) AS room FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS g, count(*) AS k, sum(n * n) AS nn, sum(CAST(g AS DOUBLE) * g / n) AS gg FROM {table} {by})))"


def _quantile_sql(table: str, key: str, level: float) -> str:
    """Of each row (key, a, b) of a table, as key and q."""
    reach = f"{REACH} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
    return f"""(SELECT {key}, min(x) AS q FROM (SELECT {key}, x, sum(d) OVER (PARTITION BY {key} ORDER BY k) AS c, sum(d) OVER (PARTITION BY {key}) AS total FROM (
        SELECT {key}, k, x, exp(v - max(v) OVER (PARTITION BY {key})) AS d FROM (SELECT {key}, k, x, (a - 1) * ln(x) + (b - 1) * ln(1 - x) AS v FROM (
        SELECT {key}, k, a, b, lo + (k + 0.5) * (hi - lo) / {GRID} AS x FROM (SELECT {key}, a, b, greatest(0.0, a / (a + b) - {reach}) AS lo, least(1.0, a / (a + b) + {reach}) AS hi FROM {table}), range({GRID}) g(k)))))
        WHERE c >= {level} * total GROUP BY {key})"""


ORACLE_SQL = {
    "op3_url_filter": rf"""
        WITH p AS (
            SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                   regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') AS shown
            FROM pages),
        j AS (
            SELECT host, len(list_filter(regexp_split_to_array(shown, '\s+'), lambda x: x <> '')) >= {WORDS}
                   AND length(regexp_replace(shown, '[^#*$%&|<>]', '', 'g')) < {SYMBOL_SHARE} * length(shown) AS good FROM p),
        h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE good) AS g,
                     CASE WHEN regexp_matches(host, '(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$') THEN 2 ELSE 1 END AS k FROM j GROUP BY host),
        l AS (SELECT *, array_to_string(string_split(host, '.')[-k:], '.') AS suffix, array_to_string(string_split(host, '.')[-(k + 1):], '.') AS domain FROM h),
        dn AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(g) AS g FROM l GROUP BY domain),
        sn AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM dn GROUP BY suffix),
        t AS (SELECT 1 AS one, * FROM (SELECT (sum(g) + 0.5) / (sum(n) + 1) AS rate FROM sn), {_strength_sql("sn", "", "of_suffix")}, {_strength_sql("dn", "suffix", "of_domain")}, {_strength_sql("l", "domain", "of_host")}, {_strength_sql("l", "", "spread")}),
        ta AS (SELECT one, rate * spread AS a, (1 - rate) * spread AS b FROM t),
        s AS (SELECT suffix, (g + rate * of_suffix) / (n + of_suffix) AS above FROM sn, t),
        d AS (SELECT domain, (g + above * of_domain) / (n + of_domain) AS above FROM dn JOIN s USING (suffix), t),
        b AS (SELECT host, g + above * of_host AS a, n - g + (1 - above) * of_host AS b FROM l JOIN d USING (domain), t),
        r AS (SELECT host, h.q AS bound, f.q AS floor FROM {_quantile_sql("b", "host", UPPER)} h, {_quantile_sql("ta", "one", LOWER)} f),
        f AS (SELECT page_id, host, path, {_RULES_SQL} AS rule FROM p)
        SELECT page_id, host, path, rule, {_VERDICT_SQL} AS verdict, round(bound, 6) AS bound, round(floor, 6) AS floor FROM f LEFT JOIN r USING (host)""",
}
