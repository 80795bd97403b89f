import random
import re

import duckdb
import pytest

from tracewell.llm import licenses
from tracewell.llm.licenses import TEMPLATES, Scanner, TokenAutomaton, Var, as_regex, license_matches, license_report, parse


def test_markup():
    got = parse('The <<beginOptional>>very <<beginOptional>>own <<endOptional>><<endOptional>>text of <<var;name="x";original="me";match=".{1,3}">>, end <<alt;a="one two";b="three">>')
    assert got == ["the", ("optional", ["very", ("optional", ["own"])]), "text", "of", Var(1, 3), "end", ("alt", [["one", "two"], ["three"]])]
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", '<<var;name="x";match="[a-z]">>', "<<what>>"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        Scanner({"empty": "<<beginOptional>>all<<endOptional>>"})


def variant(rng, items):
    """Words that the template accepts, regions filled or left at random."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, Var):
            out += [rng.choice("alpha beta gamma".split()) for _ in range(rng.randint(item.least, min(item.most, item.least + 4)))]
        elif item[0] == "optional":
            out += variant(rng, item[1]) if rng.random() < 0.5 else []
        else:
            out += rng.choice(item[1])
    return out


@pytest.mark.parametrize("name", TEMPLATES)
def test_variants_match_and_changed_words_dont(name):
    rng = random.Random(name)
    items = parse(TEMPLATES[name])
    automaton, pattern = TokenAutomaton(items), re.compile(as_regex(items))
    for _ in range(20):
        words = variant(rng, items)
        assert automaton.accepts(words)
        run = licenses.anchor(items)
        at = next(i for i in range(len(words)) if words[i : i + len(run)] == run) + rng.randrange(len(run))
        for broken in (words[:at] + ["zeta"] + words[at + 1 :], words[:at] + words[at + 1 :], words[:at] + ["zeta"] + words[at:] if words[at - 1 : at] and at else None):
            if broken is not None:
                want = pattern.fullmatch("".join(f"<{w}>" for w in broken))
                assert automaton.accepts(broken) == bool(want)


def sample_rows():
    rng = random.Random(3)
    names, rows = list(TEMPLATES), []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choices("some other words about license software the under terms licensed".split(), k=rng.randint(0, 12))))
            words = variant(rng, parse(TEMPLATES[rng.choice(names)]))
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "zeta"
            parts.append(", ".join(words).title() if rng.random() < 0.5 else "\n".join(words))
        rows.append((i, " ".join(parts) + "."))
    rows += [(900, "Released under the MIT License."), (900, "Released under the MIT License."), (901, "Licensed under the Apache License, Version 2.0."), (902, "Licensed under CC BY-NC 4.0."),
             (903, "This work is licensed under the GNU General Public License, version 3."), (904, "released under the MIT licence; MIT License; under the Apache License")]
    return rows


def test_against_sql(spark):
    rows = sample_rows()
    got = sorted(map(tuple, license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(licenses.oracle()).fetchall())
    assert {r[1] for r in got} == set(TEMPLATES) and sum(r[0] == 900 for r in got) == 2 and not any(r[0] == 904 for r in got)


def test_edge_rows(spark):
    long = "w " * 300_000 + "Released under the MIT License. " * 3
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (None, "so: RELEASED -- under the\n\nmit license!", "y"), (5, "İ released under the MIT License", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(map(tuple, license_matches(docs).collect()), key=lambda r: (r[0] or 0, r[2]))
    assert [r[:4] for r in got] == [(None, "MIT-notice", 1, 5), *[(3, "MIT-notice", 300_000 + 5 * i, 5) for i in range(3)], (5, "MIT-notice", got[-1][2], 5)]
    assert rows[3][1][got[0][4] : got[0][5]] == "RELEASED -- under the\n\nmit license" and got[-1][4] is None
    assert license_matches(docs.limit(0)).count() == 0


@pytest.mark.parametrize("match, least", [(".+", 1), (".*", 0), (".{3,}", 3)])
def test_regions_without_end(match, least):
    scanner = Scanner({"x": f'begin of it <<var;name="v";match="{match}">> end of it'})
    for n in (0, 1, 2, 3, 999, 1000, 1001, 40_000):
        found = scanner("so begin of it " + "word " * n + "end of it all")
        assert found == ([("x", 1, n + 6, 3, 3 + 12 + 5 * n + 9)] if n >= least else [])
    # the longest match of the leftmost start, as the regular expression has it
    rng = random.Random(1)
    items = parse(f'a <<var;name="v";match="{match}">> b <<beginOptional>>a<<endOptional>>')
    automaton, pattern = TokenAutomaton(items), re.compile(as_regex(items))
    for _ in range(300):
        words = rng.choices("abc", k=rng.randint(0, 12))
        text = "".join(f"<{w}>" for w in words)
        assert list(automaton.matches(words)) == [(m.start() // 3, m.end() // 3) for m in pattern.finditer(text)]


def test_underscores_and_ids_of_any_type(spark):
    assert parse("snake_case word") == ["snake_case", "word"]
    docs = spark.createDataFrame([("one", "Released under the MIT License")], "name string, text string")
    assert [tuple(r)[:2] for r in license_matches(docs, doc_id="name").collect()] == [("one", "MIT-notice")]
    texts = {
        "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC-BY-4.0-notice": "licensed under CC BY 4.0",
    }
    for name, text in texts.items():
        assert [m[0] for m in Scanner(TEMPLATES)(text)] == [name]
