import random
from collections import defaultdict

import numpy as np

from tracewell.llm import substrings
from tracewell.llm.substrings import MIN_WORDS, Subtree, Words, repeated_passages, runs, subtrees


def test_equal_windows_belong_to_equal_sequences():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 40, 90).astype(np.uint32)
    texts = [np.concatenate([rng.integers(0, 40, rng.integers(0, 80)).astype(np.uint32), shared, rng.integers(0, 40, rng.integers(0, 80)).astype(np.uint32)]) for _ in range(6)]
    texts += [np.zeros(70, np.uint32), rng.integers(0, 5, 20).astype(np.uint32)]
    gram, start, count = runs(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    flat, begins = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    seen = {}
    for g, s, n in zip(gram, start, count):
        for p in range(s, s + n):
            assert seen.setdefault(flat[p : p + MIN_WORDS].tobytes(), g) == g
    want = sum(max(0, len(t) - MIN_WORDS + 1) for t in texts)
    assert count.sum() == want and all(np.searchsorted(begins, s, "right") == np.searchsorted(begins, s + n + MIN_WORDS - 2, "right") for s, n in zip(start, count))


def test_subtrees_partition_and_find_repeats():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 400).astype(np.uint32)
    text[200:290] = text[20:110]
    places = np.arange(len(text) - MIN_WORDS + 1)
    for limit in (10, 60, 10_000):
        groups = list(subtrees(places, text, MIN_WORDS, limit))
        assert sorted(np.concatenate(groups).tolist()) == places.tolist()
        assert limit > 100 or all(len(g) <= limit for g in groups)
        got = set()
        for g in groups:
            tree = Subtree(g, text, MIN_WORDS)
            node = tree.nodes(MIN_WORDS)
            for a, b, depth in zip(tree.suffixes.tolist(), tree.suffixes[1:].tolist(), tree.common[1:].tolist()):
                shared = next((j for j in range(MIN_WORDS) if text[a + j] != text[b + j]), MIN_WORDS)
                assert depth == shared and (shared == MIN_WORDS or text[a + shared] < text[b + shared])
            for n in set(node[node >= 0].tolist()):
                got.add(tuple(sorted(tree.suffixes[node == n].tolist())))
        by = defaultdict(list)
        for p in places.tolist():
            by[text[p : p + MIN_WORDS].tobytes()].append(p)
        assert got == {tuple(v) for v in by.values() if len(v) > 1}


def brute(rows, MIN_WORDS=MIN_WORDS):
    """Passages by looking at every window of every text."""
    by_text = defaultdict(list)
    for d, t in rows:
        if t is not None:
            by_text[t].append(d)
    first = {t: min((d for d in ids if d is not None), default=None) for t, ids in by_text.items()}
    order = sorted(first, key=lambda t: (first[t] is None, first[t] or 0))
    seen, where = defaultdict(list), {}
    for t in order:
        w = t.split()
        for p in range(len(w) - MIN_WORDS + 1):
            seen[tuple(w[p : p + MIN_WORDS])].append((t, p))
    out = []
    for t in order:
        w = t.split()
        if len(w) < MIN_WORDS:
            continue
        spans = []
        for p in range(len(w) - MIN_WORDS + 1):
            places = seen[tuple(w[p : p + MIN_WORDS])]
            if len(places) > 1:
                source, q = places[0]
                if spans and spans[-1][0] + spans[-1][1] - MIN_WORDS + 1 == p and spans[-1][2] == source and spans[-1][3] + p - spans[-1][0] == q:
                    spans[-1][1] += 1
                else:
                    spans.append([p, MIN_WORDS, source, q])
        ids = sorted(by_text[t], key=lambda d: (d is None, d or 0))
        rows_of_first = {(p, n, first[s], q) for p, n, s, q in spans} | ({(0, len(w), first[t], 0)} if len(ids) > 1 else set())
        out += [(ids[0], *r) for r in rows_of_first]
        out += [(d, 0, len(w), first[t], 0) for d in ids[1:]]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    long, mid, exact, short = make(140), make(75), make(50), make(49)
    rows = [(i, make(rng.randint(1, 300))) for i in range(60)]
    for i in range(100, 130):
        parts = [make(rng.randint(0, 90)), rng.choice([long, mid, exact, short]), make(rng.randint(0, 90)), rng.choice([long, mid, exact, short])]
        rows.append((i, "  \n".join(parts)))
    rows += [(200, long), (201, long), (202, long + " " + long), (203, "st " * 130), (204, "st " * 60 + "x " * 60), (205, short), (206, short)]
    rows += [(5, rows[5][1]), (207, exact), (208, make(60) + " " + mid)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len(want) > 60
    assert collected(repeated_passages(docs)) == want


def test_hot_sequences_and_other_lengths(spark, monkeypatch):
    """Sequences too frequent for a task, all of them or some, and passages of other lengths."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for hot in (1, 8):
        monkeypatch.setattr(substrings, "HOT_RUNS", hot)
        assert collected(repeated_passages(docs)) == want
    monkeypatch.undo()
    short = [r for r in rows if r[1] is None or len(r[1]) < 900]
    for n in (7, 30):
        assert collected(repeated_passages(spark.createDataFrame(short, "doc_id long, text string"), min_words=n)) == brute(short, n)


def test_ids_of_any_type(spark):
    rows = corpus()
    named = [(None if d is None else f"d{d:05d}", t) for d, t in rows]
    want = sorted([(f"d{a:05d}", p, n, f"d{b:05d}", q) for a, p, n, b, q in brute(rows)], key=repr)
    assert collected(repeated_passages(spark.createDataFrame(named, "name string, text string"), doc_id="name")) == want


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, 1), (2, "", 2), (3, long, 3), (4, "pre " + long, 4), (5, "few words", 5), (5, "few words", 5), (None, " ".join("abc" for _ in range(50)), 6), (7, "a " * 50, 7), (7, "a " * 50, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gram int")
    got = collected(repeated_passages(docs))
    assert got == brute([r[:2] for r in rows])
    assert (3, 0, 60_000, 3, 0) in got and (4, 1, 60_000, 3, 0) in got and sum(r[0] == 7 for r in got) == 2
    assert not any(r[0] in (1, 2, 5, None) for r in got)
    assert repeated_passages(docs.limit(0)).count() == 0


def test_words():
    cut = Words()
    assert cut("a b a").tolist()[0] == cut("x a").tolist()[1] and len(cut("")) == 0
