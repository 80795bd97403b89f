"""License scans: templates with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm.common import quoted

_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY <<var;name="copyrightHolderAsIs";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<var;name="copyrightHolderLiability";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,20}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name="bullet1";original="1.";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name="bullet2";original="2.";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

_AS_IS_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{1,8}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="author2";original="THE AUTHOR";match=".{1,8}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(license: str, version: str) -> str:
    """The notice that the GNU licenses ask for at the head of each file."""
    minor = version.replace(".0", "<<beginOptional>>.0<<endOptional>>")
    return f"""<<var;name="work";original="This program";match=".{{1,4}}">> is free software; you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software
Foundation<<alt;one=", either version";two=", version">> {minor} <<beginOptional>>of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>"""


def _gpl(version: str) -> str:
    return f"""<<var;name="work";original="This work";match=".{{2,2}}">> is <<alt;one="licensed";two="released">> under the <<beginOptional>>terms of the <<endOptional>>GNU General Public
License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version {version}<<beginOptional>>.0<<endOptional>><<beginOptional>> of the
License<<beginOptional>>, or (at your option) any later version<<endOptional>><<endOptional>>"""


def _cc(name: str, short: str) -> str:
    return f"""Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>Creative Commons <<endOptional>><<alt;long="{name}";short="{short}">> 4.0<<beginOptional>>
International<<endOptional>><<beginOptional>> License<<endOptional>>"""


#: Full texts, the notices that licenses ask for in files, and the short ones that name a license, by name.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="work";original="this software and associated documentation files";match=".{1,12}">>
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD_TWO} {_AS_IS_BSD}",
    "BSD-3-Clause": f"""{_BSD_TWO} <<var;name="bullet3";original="3.";match=".{{0,1}}">> Neither the name of <<var;name="organization";original="the copyright holder";match=".{{1,12}}">> nor the names of
<<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS_BSD}""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. {_AS_IS_ISC}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AS_IS_ISC}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<var;name="bullet1";original="1.";match=".{0,1}">> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;name="bullet2";original="2.";match=".{0,1}">> Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. <<var;name="bullet3";original="3.";match=".{0,1}">> This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable
object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0-notice": """To the extent possible under law, <<var;name="holder";original="the author";match=".{1,20}">> <<alt;one="has";two="have">> waived all copyright and related or neighboring rights to""",
    "GPL-2.0-header": _gnu("General Public License", "2.0"),
    "GPL-3.0-header": _gnu("General Public License", "3.0"),
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3.0"),
    "AGPL-3.0-header": _gnu("Affero General Public License", "3.0"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
<<alt;one="http";two="https">>://mozilla.org/MPL/2.0/""",
    "EPL-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License <<beginOptional>>v<<endOptional>><<beginOptional>>v.
<<endOptional>>2.0 which <<alt;one="is available at";two="accompanies this distribution and is available at">> <<alt;one="http";two="https">>://www.eclipse.org/legal/epl-2.0""",
    "MIT-notice": """<<beginOptional>>This <<var;name="work";original="software";match=".{1,3}">> is <<endOptional>><<alt;one="released";two="licensed">> under the <<beginOptional>>terms of the <<endOptional>>MIT License""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at <<beginOptional>><<alt;one="http";two="https">>://<<endOptional>>www.apache.org/licenses/LICENSE-2.0<<endOptional>>""",
    "GPL-2.0-notice": _gpl("2"),
    "GPL-3.0-notice": _gpl("3"),
    "CC-BY-4.0-notice": _cc("Attribution", "CC BY"),
    "CC-BY-SA-4.0-notice": _cc("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-NC-4.0-notice": """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC BY-NC 4.0<<beginOptional>> International<<endOptional>><<beginOptional>>
License<<endOptional>>""",
}

_WORD = re.compile(r"\w+")
_TAG = re.compile(r"<<(.*?)>>", re.S)
_RANGE = re.compile(r"\.(?:\{(\d+)(?:,(\d*))?\}|([*+]))$")


# ---- templates


@dataclass(frozen=True)
class Var:
    """Any words, ``least`` to ``most`` of them, or any more than ``least`` where ``most`` is None."""

    least: int
    most: int | None


def parse(markup: str) -> list:
    """A template as a list of words, Vars, ("optional", list) and ("alt", [words, words])."""
    pieces, at = [], 0
    for tag in _TAG.finditer(markup):
        pieces += [("text", markup[at : tag.start()]), ("tag", tag.group(1).strip())]
        at = tag.end()
    pieces.append(("text", markup[at:]))
    stack: list[list] = [[]]
    for kind, value in pieces:
        if kind == "text":
            stack[-1] += _WORD.findall(value.lower())
        elif value == "beginOptional":
            stack.append([])
        elif value == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif value.startswith("alt;"):
            stack[-1].append(("alt", [_WORD.findall(v.lower()) for v in re.findall(r'\w+="([^"]*)"', value)]))
        elif value.startswith("var;"):
            given = re.search(r'match="(.*?)"', value)
            m = _RANGE.match(given.group(1)) if given else None
            if m is None:
                raise ValueError(f"<<{value}>>: match must be .*, .+, .{{a}}, .{{a,}} or .{{a,b}}, in words")
            least = int(m.group(1)) if m.group(1) else int(m.group(3) == "+")
            most = int(m.group(2)) if m.group(2) else least if m.group(1) and "," not in given.group(1) else None
            stack[-1].append(Var(least, most))
        else:
            raise ValueError(f"unknown markup <<{value}>>")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def as_regex(items: list) -> str:
    """The template as a regular expression over words written as <word>; an independent statement for SQL and tests."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(f"<{item}>")
        elif isinstance(item, Var):
            out.append(f"(?:<[^<>]*>){{{item.least},{'' if item.most is None else item.most}}}")
        elif item[0] == "optional":
            out.append(f"(?:{as_regex(item[1])})?")
        else:
            out.append("(?:" + "|".join("".join(f"<{w}>" for w in words) for words in item[1]) + ")")
    return "".join(out)


class TokenAutomaton:
    """A template as a nondeterministic automaton over words; state 0 is the start."""

    def __init__(self, items: list) -> None:
        self.words: list[dict[str, int]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.any: list[int] = [-1]
        self.end = self._add(items, 0)
        self.closed = [self._closure(s) for s in range(len(self.words))]
        self.first = frozenset(w for s in self.closed[0] for w in self.words[s])
        self.open_start = any(self.any[s] >= 0 for s in self.closed[0])

    def _new(self) -> int:
        self.words.append({})
        self.skips.append([])
        self.any.append(-1)
        return len(self.words) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, str):
                at = self._word(at, item)
            elif isinstance(item, Var):
                for _ in range(item.least):
                    at = self._any(at)
                last = self._new()
                if item.most is None:  # a loop, however many words there are
                    loop = self._new()
                    self.skips[at].append(loop)
                    self.any[loop] = loop
                    at = loop
                for _ in range((item.most or item.least) - item.least):
                    self.skips[at].append(last)
                    at = self._any(at)
                self.skips[at].append(last)
                at = last
            elif item[0] == "optional":
                inner = self._new()
                self.skips[at].append(inner)
                end = self._add(item[1], inner)
                self.skips[at].append(end)
                at = end
            else:
                last = self._new()
                for words in item[1]:
                    start = self._new()
                    self.skips[at].append(start)
                    for w in words:
                        start = self._word(start, w)
                    self.skips[start].append(last)
                at = last
        return at

    def _word(self, at: int, word: str) -> int:
        if word in self.words[at]:  # a state of its own for each way on
            start = self._new()
            self.skips[at].append(start)
            at = start
        self.words[at][word] = self._new()
        return self.words[at][word]

    def _any(self, at: int) -> int:
        self.any[at] = to = self._new()
        return to

    def _closure(self, state: int) -> frozenset[int]:
        seen, work = {state}, [state]
        while work:
            for to in self.skips[work.pop()]:
                if to not in seen:
                    seen.add(to)
                    work.append(to)
        return frozenset(seen)

    def _first(self, words: list[str], begin: int) -> tuple[int, int] | None:
        """(start, end) of the leftmost match from ``begin`` on, the longest of those with that start.

        One pass for all starts at once: each state has the least start that led to it, which is enough, as
        what follows depends on the state alone.
        """
        states: dict[int, int] = {}
        best, n, first = None, len(words), self.first
        for i in range(begin, n + 1):
            if (start := states.get(self.end)) is not None and (best is None or start <= best[0]):
                best = (start, i)
                states = {q: s for q, s in states.items() if s <= start}
            if i == n or best is not None and not states:
                break
            word = words[i]
            if best is None and (self.open_start or word in first):
                for q in self.closed[0]:
                    states.setdefault(q, i)
            if not states:
                continue
            reached: dict[int, int] = {}
            for q, s in states.items():
                for to in (self.words[q].get(word, -1), self.any[q]):
                    if to >= 0:
                        for c in self.closed[to]:
                            if reached.get(c, n) > s:
                                reached[c] = s
            states = reached
        return best

    def matches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(start, end) of the matches, leftmost and longest first, none overlapping another."""
        at = 0
        while (found := self._first(words, at)) is not None:
            yield found
            at = found[1]

    def accepts(self, words: list[str]) -> bool:
        return self._first(words, 0) == (0, len(words))


def anchor(items: list) -> list[str]:
    """The longest run of words that every match has."""
    best: list[str] = []
    now: list[str] = []
    for item in [*items, None]:
        if isinstance(item, str):
            now.append(item)
            continue
        if len(now) > len(best):
            best = now
        now = []
    return best


class Scanner:
    """Finds the matches of all templates in a text, leftmost and longest first, none overlapping another of its license."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.automata: list[tuple[str, TokenAutomaton, list[str], str]] = []
        for name, markup in templates.items():
            items = parse(markup)
            run = anchor(items)
            if not run:
                raise ValueError(f"{name}: a template needs words that are neither optional nor replaceable")
            self.automata.append((name, TokenAutomaton(items), run, max(run, key=len)))

    def __call__(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(license, first word, words, first sign, sign after the last) of each match."""
        lower = text.lower()
        likely = [a for a in self.automata if a[3] in lower]
        if not likely:
            return []
        spans = [m.span() for m in _WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        joined = f" {' '.join(words)} "
        same = len(lower) == len(text)
        out = []
        for name, automaton, run, _ in likely:
            if f" {' '.join(run)} " not in joined:
                continue
            for i, end in automaton.matches(words):
                out.append((name, i, end - i, spans[i][0] if same else -1, spans[end - 1][1] if same else -1))
        return out


# ---- the operator

def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, start_word, n_words, start_char, end_char): each place where a template matches.

    Texts are compared word by word, without case, punctuation and white space.  Words outside optional
    and replaceable regions must all be there, in order and with nothing between; a replaceable region
    takes the number of words its ``match`` allows.  Matches of one license don't overlap: the leftmost,
    and of those the longest, comes first.  Different licenses may match the same place.

    Null and empty texts have no rows; texts of any length are read whole; repeated rows have their matches
    each; an empty table gives no rows; ids may be of any type; other columns are not looked at.  Where lower case has another
    length than the text (as for U+0130), the two places in signs are null.
    """
    given = TEMPLATES if templates is None else templates
    result = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)])
    for name, kind in (("license", T.StringType()), ("start_word", T.LongType()), ("n_words", T.LongType()), ("start_char", T.LongType()), ("end_char", T.LongType())):
        result.add(name, kind)
    Scanner(given)  # a faulty template fails here

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for batch in batches:
            ids, found = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                if body:
                    for match in scanner(body):
                        ids.append(i)
                        found.append(match)
            columns = [pa.array([f[k] if k < 3 or f[k] >= 0 else None for f in found], pa.string() if k == 0 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=["doc_id", "license", "start_word", "n_words", "start_char", "end_char"])

    return docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).mapInArrow(scan, result)


def license_report(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The matches of :func:`license_matches` without places in signs, which SQL over words doesn't have."""
    return license_matches(docs, templates, doc_id, text).drop("start_char", "end_char")


def oracle(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for :func:`license_report` over ``documents``: the templates as regular expressions."""
    given = TEMPLATES if templates is None else templates
    parts = []
    for name, markup in given.items():
        pattern = as_regex(parse(markup)).replace("'", "''")
        parts.append(
            f"SELECT u, doc_id, '{name}' AS license, regexp_extract_all(t, '{pattern}') AS hit, string_split(regexp_replace(t, '{pattern}', chr(1), 'g'), chr(1)) AS gap FROM t"
        )
    return (
        "WITH t AS (SELECT row_number() OVER () AS u, doc_id, "
        "'<' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), '><') || '>' AS t FROM documents WHERE text IS NOT NULL), "
        f"m AS ({' UNION ALL '.join(parts)}), "
        "w AS (SELECT u, doc_id, license, len(hit) AS n, list_transform(hit, lambda x: len(x) - len(replace(x, '<', ''))) AS h, "
        "list_transform(gap, lambda x: len(x) - len(replace(x, '<', ''))) AS g FROM m WHERE len(hit) > 0) "
        "SELECT doc_id, license, CAST(list_sum(g[1:k]) + coalesce(list_sum(h[1:k-1]), 0) AS BIGINT) AS start_word, CAST(h[k] AS BIGINT) AS n_words "
        "FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM w)"
    )
