import re

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from strata.llm import url_filter as u


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(r), r, v) for v, r in u.RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["https://A.Example.ORG/es/x?q", "http://example.org", "http://notexample.org/en/12", "http://x.example.org/en/1", "x://com/de/", "x://a.com/fr/9#t", "x://xcom/fr/", None, "", "no scheme", "://", "a://b?c://d/", "http://é.com\n/fr/x", "HTTP://É.COM/fr/", "http://org/", "http://b.co.uk/x"]


def test_rules(spark):
    pages = spark.createDataFrame([(k, x, None) for k, x in enumerate(URLS)] + [(None, URLS[0], "x"), (3, URLS[3], "y")], "page_id long, url string, html string")
    for r in u.judge(pages, u.outcomes(pages)).join(pages.select("page_id", "url").distinct(), "page_id").collect():
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict)
    assert u.judge(pages, u.outcomes(pages)).count() == len(URLS) + 2
    assert u.judge(pages.limit(0), u.outcomes(pages.limit(0))).count() == 0


def quantile(a, b, level):
    """By a fine grid."""
    x = (np.arange(400_000) + 0.5) / 400_000
    v = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
    d = np.cumsum(np.exp(v - v.max()))
    return x[np.searchsorted(d, level * d[-1])]


def test_beta_quantiles(spark):
    cases = [(1.0, 1.0), (5.0, 2.0), (0.5, 0.5), (900.0, 100.0), (50_000.0, 10.0), (0.3, 40.0), (2e6, 3e6)]
    frame = spark.createDataFrame(cases, "a double, b double")
    for level in (0.05, 0.95):
        for (a, b), r in zip(cases, frame.select(u.beta_quantile(F.col("a"), F.col("b"), level).alias("q")).collect(), strict=True):
            sd = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
            assert abs(r.q - quantile(a, b, level)) <= (0.05 if min(a, b) >= 1 else 0.25) * sd + 1e-5, (a, b, level)  # below 1 the density has a pole


def plain_strength(groups):
    """Moments of the beta-binomial, pooled over groups of (pages, good)."""
    s = chance = room = 0.0
    for rows in groups:
        n, g = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
        p = g.sum() / n.sum()
        s += (n * (g / n - p) ** 2).sum()
        chance += p * (1 - p) * (len(n) - 1)
        room += p * (1 - p) * (n.sum() - (n * n).sum() / n.sum() - (len(n) - 1))
    share = min(1 / (1 + u.WEAKEST), max(1 / (1 + u.STRONGEST), (s - chance) / room)) if room > 0 else 1 / (1 + u.UNKNOWN)
    return (1 - share) / share


def test_strength_is_estimated(spark):
    rng = np.random.default_rng(5)
    for true in (2.0, 10.0, 60.0):
        rows = [(f"d{k % 9}", int(n), int(rng.binomial(n, rng.beta(0.7 * true, 0.3 * true)))) for k, n in enumerate(rng.integers(5, 80, 900))]
        got = u.strength(spark.createDataFrame(rows, "domain string, pages long, good long"), "domain", "m").collect()[0].m
        want = plain_strength([[r[1:] for r in rows if r[0] == d] for d in sorted({r[0] for r in rows})])
        assert got == pytest.approx(want, rel=1e-9) and 0.7 * true < got < 1.4 * true
    same = spark.createDataFrame([("d", 100, 70)] * 50, "domain string, pages long, good long")
    assert u.strength(same, "domain", "m").collect()[0].m == pytest.approx(u.STRONGEST)
    assert u.strength(same.limit(1), "domain", "m").collect()[0].m == u.strength(same.limit(0), None, "m").collect()[0].m == u.UNKNOWN


def test_bad_hosts_are_blocked_and_new_ones_are_not(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        p = 0.05 if k < 6 else rng.beta(36, 4)
        rows += [(f"http://h{k}.d{k % 12}.{'net' if k % 2 else 'com'}/x", bool(rng.random() < p)) for _ in range(60)]
    rows += [("http://new.d3.net/1", False), ("http://odd.d4.com/1", None), (None, True)]
    judged = spark.createDataFrame(rows, "url string, good boolean")
    pages = judged.select(F.monotonically_increasing_id().alias("page_id"), "url")
    verdicts = {r.host: r.verdict for r in u.judge(pages, judged, ()).collect()} if u.RULES else {}
    assert {h for h, v in verdicts.items() if v == "block"} == {f"h{k}.d{k % 12}.{'net' if k % 2 else 'com'}" for k in range(6)}
    got = {r.host: r for r in u.reputation(judged).collect()}
    assert got["new.d3.net"].bound > got["h0.d0.com"].bound and 0 < got["new.d3.net"].mean  # one page proves little
    assert "odd.d4.com" not in got and len({r.floor for r in got.values()}) == 1


def test_suffixes(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "a.b.com": ("com", "b.com"), "com": ("com", "com"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "xco.uk": ("uk", "xco.uk")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    s = u.suffix_of(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in frame.select("host", s, u.domain_of(F.col("host"), s)).collect()} == hosts


def test_sql(spark):
    same(spark, u.op3_url_filter, u.ORACLE_SQL["op3_url_filter"], "/root/testdata/sf0.01")
