import random

import numpy as np

from tracewell.llm import simhash
from tracewell.llm.graph import components
from tracewell.llm.simhash import Fingerprinter, Forest, GrayIndex, drop_near_duplicates, gray_rank, near_duplicate_groups


def distance(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_gray_rank_orders_the_gray_sequence():
    n = np.arange(1 << 10, dtype=np.uint64)
    gray = n ^ (n >> np.uint64(1))
    high, low = gray_rank(np.zeros_like(gray), gray)
    assert (low == n).all() and (high == 0).all()
    # with a high word of odd parity the low half runs backwards
    high, low = gray_rank(np.full(4, 1, np.uint64), np.array([0, 1, 3, 2], np.uint64))
    assert (np.diff(low.astype(object)) == -1).all()


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    rows = []
    for _ in range(900):
        c = centers[rng.integers(40)].copy()
        for bit in rng.choice(128, rng.integers(0, 16), replace=False):
            c[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append(c)
    prints, group = np.array(rows), rng.integers(0, 5, 900)
    index = GrayIndex(group, prints)
    for limit in (0, 7, 20):
        got = {tuple(sorted((int(index.order[i]), int(index.order[j])))) for a, b in index.near_pairs(limit, most=512) for i, j in zip(a, b)}
        want = {(i, j) for i in range(900) for j in range(i + 1, 900) if group[i] == group[j] and distance(prints[i], prints[j]) <= limit}
        assert got == want
    assert list(GrayIndex(np.empty(0, np.int64), np.empty((0, 2), np.uint64)).near_pairs(3)) == []


def test_forest():
    forest = Forest(6)
    forest.join(np.array([5, 3, 1]), np.array([3, 4, 0]))
    assert forest.parent.tolist() == [0, 0, 2, 3, 3, 3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "the", "ti", "on", "re", "ou"]) for _ in range(rng.randint(1, 4))) + str(i % 7) for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 200))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)]
    copies = {}
    for k in range(80):
        source = rng.randrange(n)
        w = texts[source].split()
        for p in rng.sample(range(len(w)), max(1, len(w) // 25)):
            w[p] = rng.choice(vocabulary)
        rows.append((n + k, " ".join(w).upper() + "!"))
        copies[n + k] = source
    return rows, copies


def test_groups_match_brute_force(spark):
    rows, copies = corpus()
    got = {r.doc_id: r for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = Fingerprinter()([t for _, t in rows])
    forest = Forest(len(rows))
    pairs = np.array([(i, j) for i in range(len(rows)) for j in range(i) if distance(prints[i], prints[j]) <= simhash.MAX_DISTANCE])
    forest.join(pairs[:, 0], pairs[:, 1])
    want = {i: int(forest.parent[i]) for i in range(len(rows))}
    same = sum(got[i].group_id == want[i] for i in want)
    assert same >= 0.97 * len(rows)
    assert sum(got[c].group_id == got[s].group_id for c, s in copies.items()) >= 0.95 * len(copies)
    alone = [i for i in range(300) if i not in copies.values()]
    assert all(got[i].group_size == 1 and got[i].kept for i in alone)


def test_recall_of_tables():
    """Pairs at the largest distance share a table key about as often as promised."""
    rng = np.random.default_rng(2)
    tables = simhash.key_tables(12)
    a = rng.integers(0, 1 << 63, (600, 2), dtype=np.uint64)
    b = a.copy()
    for row in b:
        for bit in rng.choice(128, simhash.MAX_DISTANCE, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    met = (simhash.table_keys(a, tables) == simhash.table_keys(b, tables)).any(0)
    assert met.mean() > 0.92


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, None, 1), (2, None, 2), (3, "", 3), (4, "  ", 4), (5, "?!", 5), (6, long, 6), (7, long + " extra", 7),
        (None, "alpha beta gamma delta", 8), (9, "Alpha, beta; gamma delta.", 9), (9, "alpha beta gamma delta", 10),
        (None, "lonely text of nobody", 11), (12, "twice the same", 12), (12, "twice the same", 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid long")
    got = sorted(((r.doc_id or -1, r.group_id, r.group_size, r.kept) for r in near_duplicate_groups(docs).collect()), key=repr)
    assert len(got) == len(rows)
    assert [x for x in got if x[0] in (1, 2)] == [(1, 1, 1, True), (2, 2, 1, True)]
    assert sorted(x for x in got if x[0] in (3, 4)) == [(3, 3, 2, True), (4, 3, 2, False)]
    assert [x for x in got if x[0] == 5] == [(5, 5, 1, True)]
    assert sorted(x for x in got if x[0] in (6, 7)) == [(6, 6, 2, True), (7, 6, 2, False)]
    assert sorted(x[1:] for x in got if x[1] == 9) == [(9, 3, False), (9, 3, False), (9, 3, True)]
    assert sorted(x[3] for x in got if x[0] == 12) == [False, True]
    assert (-1, None, 1, True) in got
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sum(1 for r in kept.collect() if r.doc_id == 9) == 1
    assert {r.uid for r in kept.collect()} >= {1, 2, 3, 5, 6, 11, 12} and kept.count() == 8
    empty = docs.limit(0)
    assert near_duplicate_groups(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_pairs_are_verified_by_their_triples(spark):
    """Documents of about the same words are near by fingerprint, but only real copies are grouped."""
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(vocabulary, 296))) for i in range(30)]
    for i in range(10):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, " ".join(vocabulary)), (201, " ".join(vocabulary[::-1]))]
    prints = Fingerprinter()([t for _, t in rows])
    assert sum(distance(prints[i], prints[j]) <= simhash.MAX_DISTANCE for i in range(30) for j in range(i)) > 100
    got = {r.doc_id: r for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].group_id == i and got[i].kept for i in range(30))
    assert all(got[100 + i].group_id == i and not got[100 + i].kept for i in range(10))
    assert got[200].group_id == 200 and got[201].group_id == 201


def test_sketches_estimate_the_overlap():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    for changed in (0, 10, 60, 300):
        a = rng.choices(words, k=600)
        b = list(a)
        for p in rng.sample(range(600), changed):
            b[p] = rng.choice(words)
        triples = [set(zip(x, x[1:], x[2:])) for x in (a, b)]
        want = len(triples[0] & triples[1]) / len(triples[0] | triples[1])
        one, two = Fingerprinter().both([" ".join(a), " ".join(b)])[1]
        assert abs(simhash.overlap(one[None], two[None])[0] - want) < 0.2
    short = Fingerprinter().both(["one", "One!", "one two", "two one", "", " ", "?"])[1]
    assert (short[0] == short[1]).all() and (short[4] == short[5]).all()
    assert all(simhash.overlap(short[i][None], short[j][None])[0] == 0 for i, j in ((0, 2), (2, 3), (4, 6)))


def linked_by_brute_force(rows):
    """The number of rows that each row is linked to: all pairs, word triples counted as sets of hashes by slot."""
    both = [Fingerprinter().both([t]) for _, t in rows]
    prints, sketch = [b[0][0] for b in both], [b[1][0] for b in both]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            shared = [(a, b) for a, b in zip(sketch[i].tolist(), sketch[j].tolist()) if a or b]
            if distance(prints[i], prints[j]) <= simhash.MAX_DISTANCE and sum(a == b for a, b in shared) >= simhash.MIN_OVERLAP * len(shared):
                links[i] += 1
                links[j] += 1
    return links


def test_links_are_counted_once_and_hot_groups_are_cut(spark, monkeypatch):
    """Each linked pair counts once, however many tables and pieces it meets in."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(4000)], k=rng.randint(30, 120)))) for i in range(60)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    want = linked_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        got = {r.doc_id: r for r in near_duplicate_groups(docs).collect()}
        return [got[d].links for d, _ in rows], sum(r.kept for r in got.values())

    whole = found()
    assert sum(want) > 5000 and sum(whole[0]) >= 0.97 * sum(want) and all(a <= b for a, b in zip(whole[0], want))
    assert whole[1] == 61
    monkeypatch.setattr(simhash, "HOT_GROUP", 9)
    assert found() == whole


def scattered_prints(n, centers, most, seed):
    """Fingerprints around centers, each up to ``most - 1`` bits away from its own."""
    rng = np.random.default_rng(seed)
    bits = rng.random((centers, simhash.BITS))[rng.integers(centers, size=n)] < 0.5
    for row in bits:
        row[rng.choice(simhash.BITS, rng.integers(0, most), replace=False)] ^= True
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def test_every_pair_meets_and_is_found():
    """No pair within the distance is lost, whatever the distance and the number of key bits; each is found once."""
    for n, centers, most, limit, bits in ((2500, 900, 22, 20, 9), (2500, 900, 22, 20, 2), (1500, 500, 5, 3, 1), (600, 60, 40, 40, 4), (90, 9, 60, 127, 4), (60, 9, 60, 128, 4)):
        prints = scattered_prints(n, centers, most, n)
        tables = simhash.key_tables(bits, limit)
        keys = simhash.table_keys(prints, tables)
        group, table = np.unique(keys.ravel(), return_inverse=True)[1], np.repeat(np.arange(len(tables)), n)
        again = np.tile(prints, (len(tables), 1))
        batches = simhash.near_in_groups(group, table, again, tables, limit)
        got = [(min(a, b), max(a, b)) for i, j in batches for a, b in zip((i % n).tolist(), (j % n).tolist())]
        apart = [np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(1) for i in range(n)]
        want = {(i, i + 1 + int(j)) for i in range(n) for j in np.flatnonzero(apart[i] <= limit)}
        assert len(want) > 30 and len(got) == len(want) and set(got) == want


def test_no_link_is_left_out(spark):
    """Also copies at just the largest distance are linked, all of them."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(150):
        base = rng.choices(vocabulary, k=60)
        for c in range(3):
            words = list(base)
            for _ in range(3 * c):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((10 * k + c, " ".join(words)))
    prints = Fingerprinter()([t for _, t in rows])
    assert sum(14 < distance(prints[i], prints[i + 1]) <= simhash.MAX_DISTANCE for i in range(len(rows) - 1)) > 50
    got = {r.doc_id: r.links for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == linked_by_brute_force(rows)
