import random
import re

import pytest

from tracewell.llm import toxicity
from tracewell.llm.toxicity import FuzzyLexicon, Lexicon, Scorer, allowed_edits, drop_toxic, learn_lexicon, quotations, toxicity_scores

TERMS = ("idiot", "moron", "scum", "worthless", "disgusting", "pathetic")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mangled(rng, word, n):
    for _ in range(n):
        p, kind = rng.randrange(len(word) + 1), rng.randrange(3)
        sign = rng.choice("abcdeimorstuw0é")
        word = word[:p] + (sign + word[p:] if kind == 0 else sign + word[p + 1 :] if kind == 1 else word[p + 1 :])
    return word


def test_automaton_matches_edit_distance():
    rng = random.Random(4)
    lexicon = FuzzyLexicon(Lexicon(dict.fromkeys(TERMS, False), exact=frozenset({"pathetic"})))
    for _ in range(4000):
        word = mangled(rng, rng.choice(TERMS), rng.randint(0, 4))
        near = [(edits(word, t), t) for t in TERMS if edits(word, t) <= allowed_edits(t, t == "pathetic")]
        got = lexicon.match(word)
        assert (got and (got[1], got[0])) == (min(near) if near else None), word


def test_beginnings_and_harmless_words():
    lexicon = FuzzyLexicon(Lexicon({"vequ": True, "moron": False}, harmless=frozenset({"oron"})))
    assert lexicon.match("vequille") == ("vequ", 0) and lexicon.match("vequ") == ("vequ", 0)
    assert lexicon.match("vequx"[:3]) is None and lexicon.match("xvequ") is None
    assert lexicon.match("oron") is None and lexicon.match("mor0n") == ("moron", 1)


def test_context():
    score = Scorer(Lexicon(dict.fromkeys(TERMS, False)))
    plain = score("what an idiot that was")[0]
    assert plain == 1.0
    assert score("you are an idiot")[0] > plain
    assert score("such scum and such an idiot")[0] > plain
    assert score("what an idi0t that was")[0] < plain
    quoted = score('the report said "idiot" twice')
    assert quoted[0] < 0.6 and quoted[3] == 1
    assert score("he called them idiot")[0] < plain
    assert score("")[0] == 0 and score("a fine day")[0] == 0
    assert score("IDIOT")[0] == 1.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    syllables = ["an", "the", "ti", "on", "re", "ou", "mi", "lo", "sa"]
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "blerg", "grumf" + rng.choice(syllables)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = learn_lexicon(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    assert "blerg" in lexicon.terms and any(lexicon.terms.get("grumf"[:k]) for k in range(4, 6))
    held = {i: t for i, t in labels if i % 3 == 0}
    got = {r.doc_id: r.rejected for r in toxicity_scores(docs, lexicon).collect()}
    assert sum(got[i] for i, t in held.items() if t) >= 0.95 * sum(held.values())
    assert sum(got[i] for i, t in held.items() if not t) <= 0.01 * len(held)


def test_no_labels_and_bound(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert learn_lexicon(docs, none, seeds=("idiot",)).terms == {"idiot": False}
    few = learn_lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=300)
    assert "idiot" in few.terms


def test_edge_rows(spark):
    lexicon = Lexicon(dict.fromkeys(TERMS, False))
    long = "calm words " * 100_000 + "you pathetic idiot"
    rows = [(1, None, 1.0), (2, "", 2.0), (3, long, 3.0), (4, "what a moron", 4.0), (4, "what a moron", 4.0), (None, "fine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    got = sorted(((r.doc_id or 0, r.rejected, r.terms) for r in toxicity_scores(docs, lexicon).collect()))
    assert got == [(0, False, 0), (1, False, 0), (2, False, 0), (3, True, 2), (4, True, 1), (4, True, 1)]
    kept = drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    assert toxicity_scores(docs.limit(0), lexicon).count() == 0 and drop_toxic(docs.limit(0), lexicon).count() == 0


def test_brute_force_scan(spark):
    """Without context, scores above nought are just the texts with a near term."""
    rng = random.Random(9)
    texts = [" ".join(mangled(rng, rng.choice([*TERMS, "table", "chair", "window"]), rng.randint(0, 3)) for _ in range(4)) for _ in range(300)]
    lexicon = Lexicon(dict.fromkeys(TERMS, False))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.terms for r in toxicity_scores(docs, lexicon).collect()}
    want = {i: sum(any(edits(w, t) <= allowed_edits(t, False) for t in TERMS) for w in re.findall(r"\w+", x)) for i, x in enumerate(texts)}
    assert got == want


def test_words_stay_fuzzy_beside_their_beginnings(spark):
    """Three spellings with one beginning make a prefix term; the whole words still match misspelled."""
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices(["an", "the", "ti", "on", "re", "ou"], k=rng.randint(1, 4))) for _ in range(40)]
        if i % 4 == 0:
            words[10:10] = [rng.choice(["clown", "clown", "clowns", "clowny"])]
            words[20:20] = [rng.choice(["trash", "trash", "trashy", "trashed", "trashing"])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    lexicon = learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.terms["clow"] and lexicon.terms["tras"]
    match = FuzzyLexicon(lexicon).match
    assert match("clownish") and match("cl0wn") == ("clown", 1) and match("tr4sh") == ("trash", 1)
    both = FuzzyLexicon(Lexicon({"clown": True}, whole=frozenset({"clown"})))
    assert both.match("clownery") == ("clown", 0) and both.match("cl0wn") == ("clown", 1) and both.match("cl0wnery") is None


def test_quotations_of_any_length():
    score = Scorer(Lexicon(dict.fromkeys(TERMS, False)))
    for n in (1, 20, 70, 5000):
        for a, b in ('""', "“”", "„“", "„”", "«»"):
            inner = "calm words " * n + "what an idiot " + "calm words " * n
            got = score(f"the paper had {a}{inner.strip()}{b} in it")
            assert got[0] < 0.6 and got[3] == 1, (n, a)
    assert score('a stray " sign, you idiot, and 5" of rain')[0] > 0.6
    assert score('"calm" talk, you idiot, "calm" again')[0] > 0.6
    assert score('"a line\nyou idiot"')[0] > 0.6
    assert quotations('"a" „b“ «c» “d” "e') == [(0, 3), (4, 7), (8, 11), (12, 15)]
    assert len(quotations("„" * 200_000 + "“")) == 1


def test_beginnings_may_be_misspelled():
    match = FuzzyLexicon(Lexicon({"grumfi": True, "blor": True})).match
    assert match("grumfitude") == ("grumfi", 0) and match("grunfitude") == ("grumfi", 1) and match("gumfitude") == ("grumfi", 1)
    assert match("gunfitude") is None and match("blxrness") is None and match("blorness") == ("blor", 0)
    assert FuzzyLexicon(Lexicon({"grumfi": True}, exact=frozenset({"grumfi"}))).match("grunfitude") is None


def scored_by_hand(text, lexicon):
    """The score of a text from its definition, word by word."""
    lower = text.lower()
    words = [(m.group(), m.start()) for m in re.finditer(r"\w+", lower)]
    hits = []
    for i, (w, at) in enumerate(words):
        near = []
        for t in lexicon.terms:
            e = edits(w, t)
            if e <= allowed_edits(t, t in lexicon.exact) and not (e and w in lexicon.harmless):
                near.append((e, -lexicon.weights.get(t, 1.0), t))
        if near:
            hits.append((i, at, min(near)[2], min(near)[0]))
    best = 0.0
    for i, at, t, e in hits:
        if t in lexicon.weights:
            inside = [1 - 1.5 * f / len(u) for j, _, u, f in hits if u in lexicon.weights and i - toxicity.WEAK_WINDOW <= j <= i]
            dense = min(2.0, max(1.0, 100 / len(words))) if len(inside) > 1 else 1.0
            best = max(best, 0.2 * sum(inside) * dense)
            continue
        score = 1 - 1.5 * e / len(t)
        around = {w for w, _ in words[max(0, i - 8) : i + 9]}
        before = [j for j, *_ in hits if j < i][-1:]
        after = [j for j, *_ in hits if j > i][:1]
        company = sum(abs(j - i) <= 8 for j in before + after)
        score *= 1 + (0.5 if around & {"you", "your", "du"} else 0) + 0.25 * company
        quotes = [m.span() for m in re.finditer(r'"[^"]*"', lower)]
        if any(a <= at < b for a, b in quotes):
            score *= 0.4
        if {w for w, _ in words[max(0, i - 4) : i]} & {"said", "called"}:
            score *= 0.7
        best = max(best, score)
    return best


def test_window_scores_from_their_definition():
    rng = random.Random(12)
    lexicon = Lexicon({**dict.fromkeys(TERMS, False), "weaky": False, "softish": False}, frozenset({"morin"}), frozenset({"pathetic"}), {"weaky": 0.2, "softish": 0.2})
    score = Scorer(lexicon)
    pool = ["you", "your", "said", "called", "morin", "weaky", "weeky", "softish", "softisch", "pathetic", "patetic", "idiot", "idi0t", "scum", "worthles"] + [f"calm{i}" for i in range(25)]
    for _ in range(400):
        words = rng.choices(pool, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(len(words))
            words[a] = f'"{words[a]}"'
        text = " ".join(words)
        assert abs(score(text)[0] - scored_by_hand(text, lexicon)) < 1e-6, text


def test_labels_with_other_columns(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "key long, body string")
    named = spark.createDataFrame([(i, bool(t), i) for i, t in labels], "item long, bad boolean, doc_id long")
    lexicon = learn_lexicon(docs, named, "key", "body", label_id="item", label="bad")
    assert lexicon == learn_lexicon(docs.toDF("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int"))
