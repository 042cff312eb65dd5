import random
import re

import pytest

from strata.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def base(text):
    """n_words, n_base, first_word, last_word and base_labels."""
    w, found = words(text), []
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def pattern(parts):
    """A parsed template as a regular expression over words that each have a space behind them."""
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += re.escape(p.decode()) + " "
        elif p[0] == "optional":
            out += f"(?:{pattern(p[1])})?"
        elif p[0] == "either":
            out += "(?:" + "|".join("".join(x.decode() + " " for x in w) for w in p[1]) + ")"
        else:
            out += f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
    return out


def plain(templates, w):
    """All spans of all templates, by trying each, but for those within another."""
    found = {(s, e, t) for t, (_, m) in enumerate(templates) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if re.fullmatch(pattern(lic.parsed(m)), "".join(x + " " for x in w[s:e]))}
    return sorted((t, s, e) for s, e, t in found if not any((a <= s and e <= b) and (a, b) != (s, e) for a, b, _ in found))


SMALL = (("a", "x <<beginOptional>>y <<beginOptional>>z<<endOptional>> x<<endOptional>> z"), ("b", "y <<var;name=v;original=q;match=.{1,3}>> y"), ("c", "z <<var;name=v;match=x y|z>> <<beginOptional>>x<<endOptional>>"), ("d", "<<beginOptional>>q <<var;match=.+>><<endOptional>> x y"), ("e", "y <<var;match=.{0,2}>> z <<beginOptional>>q<<endOptional>>"))


def test_automaton_equals_trying_all_spans():
    look, rng = lic.Scanner(SMALL, ()), random.Random(7)
    for _ in range(400):
        w = [rng.choice("xyzq") for _ in range(rng.randrange(0, 14))]
        n, found = look(" ".join(w).encode())
        index = [(t, s, e) for t, (label, _) in enumerate(SMALL) for _, s, e, x in found if x == label]
        assert n == len(w)
        assert sorted(index) == plain(SMALL, w)


MIT = lic.TEMPLATES[0][1]


def text_of(markup, fill="Jane Doe 2020"):
    """A text that the template accepts: optional regions in, variables replaced."""
    return re.sub(r"<<(?:begin|end)Optional>>", " ", re.sub(r"<<var;.*?match=(.*?)>>", lambda m: fill if m[1].startswith(".") else m[1].split("|")[0], markup))


def labels(text):
    return {x[3] for x in lic.Scanner()(text.encode())[1] if x[0] == "template"}


def test_every_template_accepts_its_own_wording():
    for label, markup in lic.TEMPLATES:
        assert label in labels("Intro words. " + text_of(markup) + " and more."), markup


def test_mandatory_wording_must_match():
    text = text_of(MIT)
    assert labels(text) == {"mit"}
    assert labels(re.sub(r"^.*?Permission", "Permission", text, flags=re.S)) == {"mit"}  # an optional region is missing
    assert labels(text.replace("free of charge", "free of any charge")) == set()
    assert labels(text.replace("FITNESS ", "")) == set()
    assert labels(text.lower().replace(",", " ;\n * ")) == {"mit"}  # marks and case don't count
    assert labels(text_of(MIT, "a " * (lic.MOST_WORDS + 1))) == set()


def test_longest_match_names_the_license():
    text = "This program is licensed under the GNU General Public License, version 3"
    assert labels(text + ".") == {"gpl-3.0-only"}
    assert labels(text + ", or (at your option) any later version.") == {"gpl-3.0-or-later"}


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "a <<var;match=[a-z]+>>", "<<beginOptional>>a<<endOptional>>"])
def test_faults_in_markup(bad):
    with pytest.raises(lic.MarkupError):
        lic.Scanner((("x", bad),))


TEXTS = ["GNU General Public License, MIT license; mit-license", "cc by cc BY-nc gnu general public gnu general public license", "É apache\x7flicense apachelicense Apache_License", "mit licensé mit license", "Released under the MIT License.", None, "", "..."]


def test_base_and_odd_rows(spark, odd, empty, tmp_path):
    extra = spark.createDataFrame([(100 + k, t, None, None, None, 0, 0, 0, "") for k, t in enumerate(TEXTS)] + [(200, "mit license " * 30_000, "", "", 0, 0, 0, 0, "")], odd.schema)
    docs = odd.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:6] for r in lic.op12_license_scan(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=repr)
    assert lic.scan(empty).count() == 0


def test_whole_table(spark):
    got = {r.doc_id: r for r in lic.op12_license_scan(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert tuple(r)[1:6] == base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert {"gpl-3.0-only", "mit", "apache-2.0", "cc-by-nc-4.0"} <= {x for r in got.values() for x in r.labels.split(",")}
