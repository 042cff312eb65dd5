"""License scans by template markup.

A template is a license's wording with marked regions: what stands between <<beginOptional>> and <<endOptional>> may be
missing, and <<var;name=...;original=...;match=...>> stands for other words: match is .+ (a word or more, MOST_WORDS at most),
.* (none is fine too), .{m,n} (that many words) or words with | between them, one of which must stand there. All other words are mandatory
and must stand there as they are, one after another. Regions may be nested.

All templates are compiled into one automaton over words, whose states are places of templates. It is made deterministic
step by step, as texts need it, so that a word costs one lookup whatever the number of templates. A second one runs
backwards from where a match ends to where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from strata.llm.shared import table, utf8

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words that .+ and .* stand for at most.
MOST_WORDS = 40
#: Steps that a task remembers; beyond, it begins anew.
MOST_STEPS = 200_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^<>]*)?)>>")
ANY, OTHER = -1, 0

_COPYRIGHT = '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=copyright;original=year and holder;match=.+>><<endOptional>> <<beginOptional>>All rights reserved.<<endOptional>> '
_WORK = '<<beginOptional>><<var;name=kind;original=work;match=work|program|software|code|library|document|project|file>> is<<endOptional>> '
_LICENSED = f'{_WORK}<<var;name=verb;original=licensed;match=licensed|distributed|released|available>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> '
_AS_IS = 'PROVIDED <<beginOptional>>BY <<var;name=holder;original=the copyright holders and contributors;match=.+>><<endOptional>> "AS IS" '
_LATER = '<<var;name=or;original=or;match=or>> <<beginOptional>>(at your option)<<endOptional>> any later version'
#: Labels and the wording of licenses and of their usual notices, with markup.
TEMPLATES = (
    ("mit", _COPYRIGHT + 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;original=the authors or copyright holders;match=.+>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mit", _LICENSED + "MIT License"),
    ("isc", _COPYRIGHT + 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=author;original=the author;match=.+>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=author;original=the author;match=.+>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd-2-clause", _COPYRIGHT + 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS ' + _AS_IS),
    ("bsd-3-clause", _COPYRIGHT + 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organization;original=the copyright holder;match=.+>> nor the names of <<var;name=its;original=its;match=its|any|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS ' + _AS_IS),
    ("apache-2.0", _LICENSED + "Apache License, Version 2.0"),
    ("gpl-2.0-only", _LICENSED + "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version 2<<beginOptional>>.0<<endOptional>>"),
    ("gpl-2.0-or-later", _LICENSED + "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2<<beginOptional>>.0<<endOptional>> <<beginOptional>>of the License<<endOptional>>, " + _LATER),
    ("gpl-3.0-only", _LICENSED + "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version 3<<beginOptional>>.0<<endOptional>>"),
    ("gpl-3.0-or-later", _LICENSED + "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3<<beginOptional>>.0<<endOptional>> <<beginOptional>>of the License<<endOptional>>, " + _LATER),
    ("gpl-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, " + _LATER),
    ("gpl-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, " + _LATER),
    ("lgpl-2.1-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, " + _LATER),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", _LICENSED + "<<var;name=name;original=CC;match=cc|creative commons>> <<var;name=by;original=BY;match=by|attribution>> 4.0"),
    ("cc-by-sa-4.0", _LICENSED + "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", _LICENSED + "CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", _LICENSED + "CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", _LICENSED + "CC BY-ND 4.0"),
    *((name.lower(), f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0")),
)


class MarkupError(ValueError):
    """A template's regions are not closed, or a match says something else than the markup knows."""


def words_of(text: bytes) -> list[bytes]:
    """The words, A-Z in lower case."""
    return _WORD.findall(text.lower())


def parsed(markup: str) -> list:
    """A template as a list of words, ("optional", list), ("any", least, most) and ("either", lists)."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += words_of(markup[at : m.start() if m else len(markup)].encode())
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise MarkupError(f"endOptional without beginOptional: {markup[:80]}")
            part = stack.pop()
            stack[-1].append(("optional", part))
        else:
            rule = dict(x.partition("=")[::2] for x in m[2].strip(";").split(";")).get("match", ".+").strip('"')
            stack[-1].append(_variable(rule))
    if len(stack) > 1:
        raise MarkupError(f"beginOptional without endOptional: {markup[:80]}")
    return stack[0]


def _variable(rule: str) -> tuple:
    if rule in (".+", ".*"):
        return ("any", int(rule == ".+"), MOST_WORDS)
    if m := re.fullmatch(r"\.\{(\d+),(\d+)\}", rule):
        return ("any", int(m[1]), int(m[2]))
    if re.search(r"[][.*+?(){}\\^$]", rule) or not all(words_of(x.encode()) for x in rule.split("|")):
        raise MarkupError(f"match={rule}")
    return ("either", [words_of(x.encode()) for x in rule.split("|")])


class Automaton:
    """Templates as places and what may follow each. Sets of places are bits of an int."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.word: list[int] = []  # of each place
        self.follow: list[int] = []
        self.owner: list[int] = []
        self.first, self.last, self.own = 0, 0, []
        for k, (_, markup) in enumerate(templates):
            begin = len(self.word)
            first, last, empty = self._build(parsed(markup), k)
            if empty:
                raise MarkupError(f"no mandatory word: {markup[:80]}")
            self.first |= first
            self.last |= last
            self.own.append(((1 << len(self.word)) - 1) ^ ((1 << begin) - 1))
        self.precede = [0] * len(self.word)
        for p, f in enumerate(self.follow):
            for q in _bits(f):
                self.precede[q] |= 1 << p
        self.match = [0] * (len(self.vocabulary) + 1)
        anything = sum(1 << p for p, w in enumerate(self.word) if w == ANY)
        for w in range(len(self.match)):
            self.match[w] = anything | sum(1 << p for p, x in enumerate(self.word) if x == w != OTHER)
        #: Words that a match can begin with.
        self.begins = frozenset(w for w in range(len(self.match)) if self.first & self.match[w])
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._back: dict[tuple[int, int], int] = {}

    def _place(self, word: int, owner: int) -> int:
        self.word.append(word)
        self.follow.append(0)
        self.owner.append(owner)
        return 1 << (len(self.word) - 1)

    def _build(self, parts: list, owner: int) -> tuple[int, int, bool]:
        """The places that parts can begin and end with, and whether they can be empty."""
        first, last, empty = 0, 0, True
        for part in parts:
            if isinstance(part, bytes):
                at = self._place(self.vocabulary.setdefault(part, len(self.vocabulary) + 1), owner)
                f, e, none = at, at, False
            elif part[0] == "optional":
                f, e, _ = self._build(part[1], owner)
                none = True
            elif part[0] == "either":
                f, e, none = 0, 0, False
                for words in part[1]:
                    a, b, _ = self._build(words, owner)
                    f, e = f | a, e | b
            else:
                f, e, none = self._any(*part[1:], owner)
            for p in _bits(last):
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | e if none else e
            empty = empty and none
        return first, last, empty

    def _any(self, least: int, most: int, owner: int) -> tuple[int, int, bool]:
        places = [self._place(ANY, owner) for _ in range(most)]
        for a, b in zip(places, places[1:], strict=False):
            self.follow[a.bit_length() - 1] |= b
        ends = sum(places[max(least, 1) - 1 :])
        return (places[0] if places else 0), ends, least == 0

    def _step(self, state: int, word: int) -> tuple[int, int]:
        """The next places, and the templates that end with this word."""
        reach = self.first
        for p in _bits(state):
            reach |= self.follow[p]
        now = reach & self.match[word]
        ended = 0
        for p in _bits(now & self.last):
            ended |= 1 << self.owner[p]
        return now, ended

    def matches(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """template, start and end (of words, end exclusive) of what matches, but for what lies within another match.
        Ordered by start."""
        steps, ends, at, n, state = self._steps, [], 0, len(ids), 0
        begins = self.begins
        for at in range(n):
            word = ids[at]
            if not state and word not in begins:
                continue
            found = steps.get((state, word))
            if found is None:
                if len(steps) >= MOST_STEPS:
                    steps.clear()
                found = steps[state, word] = self._step(state, word)
            state, ended = found
            if ended:
                ends += [(t, at) for t in _bits(ended)]
        spans = sorted({(self._start(ids, t, e), -(e + 1), t) for t, e in ends})
        out, reached = [], -1
        for start, end, t in spans:  # those that begin earlier, and of these the longer, come first
            if -end > reached or out and (start, -end) == out[-1][1:]:
                out.append((t, start, -end))
                reached = max(reached, -end)
        return out

    def _start(self, ids: list[int], template: int, end: int) -> int:
        """Where the longest match of a template that ends with word `end` begins."""
        own, at = self.own[template], end
        state, start = self.last & own & self.match[ids[at]], end
        while state:
            if state & self.first:
                start = at
            at -= 1
            if at < 0:
                break
            back = self._back.get((state, ids[at]))
            if back is None:
                if len(self._back) >= MOST_STEPS:
                    self._back.clear()
                reach = 0
                for p in _bits(state):
                    reach |= self.precede[p]
                back = self._back[state, ids[at]] = reach & self.match[ids[at]]
            state = back
        return start


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Scanner:
    """Phrases and templates of a text."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        self.automaton = Automaton(list(templates))
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        for words, _ in self.phrases:
            for w in words:
                self.automaton.vocabulary.setdefault(w, len(self.automaton.vocabulary) + 1)
        extra = len(self.automaton.vocabulary) + 1 - len(self.automaton.match)
        self.automaton.match += [self.automaton.match[OTHER]] * extra
        known = self.automaton.vocabulary
        self.begins: dict[int, list] = {}
        for words, label in self.phrases:
            self.begins.setdefault(known[words[0]], []).append(([known[w] for w in words], label))

    def __call__(self, text: bytes) -> tuple[int, list[tuple[str, int, int, str]]]:
        """The number of words, and kind (phrase or template), start, end and label of what was found."""
        known, words = self.automaton.vocabulary.get, words_of(text)
        ids = [known(w, OTHER) for w in words]
        found = []
        for first, phrases in self.begins.items():
            at = -1
            for _ in range(ids.count(first)):
                at = ids.index(first, at + 1)
                found += [("phrase", at, at + len(p), label) for p, label in phrases if ids[at : at + len(p)] == p]
        found.sort()
        return len(ids), found + [("template", s, e, self.labels[t]) for t, s, e in self.automaton.matches(ids)]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in at least one span."""
    total, reached = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


SCAN = "n_words long, matches array<struct<kind:string,start:long,end:long,label:string>>, score double"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, matches (kind, start, end, label: words from 0, end exclusive) and score of every row of docs (doc_id,
    text; other columns are ignored). Phrases count at each place where they stand, templates where nothing longer holds
    them; the score is the share of the words that lie in a match, 0 without words.

    A null or empty text has no words. Rows with an equal or null doc_id each get a row. An empty table gives none.
    Nothing is shuffled; a task holds the texts of one Arrow batch.
    """
    templates, phrases = tuple(templates), tuple(phrases)
    Scanner(templates, phrases)  # a fault in the markup shows here

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        look = Scanner(templates, phrases)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            counts, matches, scores = [], [], []
            for text in utf8(batch.column(1)):
                n, found = look(text)
                counts.append(n)
                matches.append([dict(zip(("kind", "start", "end", "label"), f, strict=True)) for f in found])
                scores.append(covered([f[1:3] for f in found]) / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, kind), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "matches", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + SCAN)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("matches", lambda m: m["kind"] == "phrase"))
    starts = F.transform("base", lambda m: m["start"])
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), label("base").alias("base_labels"), label("matches").alias("labels"), "score")


QUERIES = {"op12_license_scan": op12_license_scan}
#: SQL has no automata; a test holds the query against plain code.
ORACLE_SQL: dict[str, str] = {}
