import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ivfpq
from tracewell.llm.kdtree import KdTree, exact_top_k


def vectors(n=700, dim=9, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 3
    return (centers[rng.integers(12, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)


def brute(keys, v, k):
    """Sorted (id, rank, neighbour, distance) by comparing all pairs."""
    out = []
    v = v.astype(np.float64)
    for i in range(len(v)):
        d = ((v - v[i]) ** 2).sum(1)
        others = sorted((d[j], keys[j] is None, keys[j] or 0, j) for j in range(len(v)) if j != i)[:k]
        out += [(keys[i], r + 1, keys[j], round(float(np.sqrt(x)), 6)) for r, (x, _, _, j) in enumerate(others)]
    return sorted(out, key=repr)


def frame(spark, keys, v, **more):
    return spark.createDataFrame([(k, [float(x) for x in row], 1, 2.0) for k, row in zip(keys, v)], "vec_id long, embedding array<float>, uid int, distance double")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tree_boxes_are_tight_and_split_at_medians():
    v = vectors().astype(np.float64)
    tree = KdTree(v, leaf_rows=20)
    for node, (a, b) in enumerate(tree.span):
        mine = v[tree.order[a:b]]
        assert (tree.low[node] == mine.min(0)).all() and (tree.high[node] == mine.max(0)).all()
        left, right = tree.child[node]
        if left >= 0:
            assert abs((tree.span[left][1] - tree.span[left][0]) - (tree.span[right][1] - tree.span[right][0])) <= 1
        else:
            assert b - a <= 20
    assert sorted(tree.order.tolist()) == list(range(len(v)))


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_exact_against_brute_force(spark, shard_rows):
    v = vectors()
    v[50:60] = v[40:50]  # ties
    v[300:340] = v[300]
    keys = list(range(len(v)))
    assert collected(exact_top_k(frame(spark, keys, v), k=5, shard_rows=shard_rows)) == brute(keys, v, 5)


def test_exact_edge_rows(spark):
    v = vectors(30, 4)
    keys = [None, None, 7, 7, *range(10, 36)]
    v[3] = v[2]
    docs = frame(spark, keys, v)
    odd = spark.createDataFrame(
        [(90, None, 1, 1.0), (91, [1.0, None, 2.0, 3.0], 1, 1.0), (92, [1.0, float("nan"), 0.0, 0.0], 1, 1.0), (93, [1.0], 1, 1.0), (94, [], 1, 1.0), (95, [float("inf"), 0.0, 0.0, 0.0], 1, 1.0)],
        docs.schema,
    )
    assert collected(exact_top_k(docs.unionAll(odd), k=3, shard_rows=8)) == brute(keys, v, 3)
    few = frame(spark, [1, 2], v[:2])
    assert collected(exact_top_k(few, k=5)) == brute([1, 2], v[:2], 5)
    assert exact_top_k(few.limit(0)).count() == 0
    assert exact_top_k(frame(spark, [1], v[:1])).count() == 0


def test_equal_vectors(spark):
    v = np.ones((60, 3), np.float32)
    keys = list(range(60))
    assert collected(exact_top_k(frame(spark, keys, v), k=4, shard_rows=10)) == brute(keys, v, 4)


def recall(got, want):
    mine = {(r[0], r[2]) for r in got}
    return sum((r[0], r[2]) in mine for r in want) / len(want)


@pytest.mark.parametrize("dim, clustered", [(16, True), (30, False)])
def test_approximate_recall(spark, dim, clustered):
    v = vectors(3000, dim, 3) if clustered else np.random.default_rng(4).normal(size=(3000, dim)).astype(np.float32)
    keys = list(range(len(v)))
    docs = frame(spark, keys, v).repartition(4)
    got, want = collected(ivfpq.approximate_top_k(docs)), collected(exact_top_k(docs))
    assert recall(got, want) >= 0.9
    assert len(got) == 10 * len(v)
    exact = {(r[0], r[2]): r[3] for r in want}
    assert all(abs(exact[r[0], r[2]] - r[3]) < 1e-6 for r in got if (r[0], r[2]) in exact)


def test_asymmetric_distances():
    """Tables add up to the distance of the query to the decoded vector."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 20))
    q = ivfpq.Quantizer(v[:3].copy(), 20)
    q.books = [rng.normal(size=(256, q.width)) for _ in range(ivfpq.PARTS)]
    lists = ivfpq._nearest(v, q.centers)
    codes = ivfpq.split(q.encode(v, lists))
    tables = q.tables(v[:5], 1)
    decoded = np.concatenate([b[codes[:, j]] for j, b in enumerate(q.books)], 1)
    padded = np.zeros((5, q.width * ivfpq.PARTS))
    padded[:, :20] = v[:5] - q.centers[1]
    want = ((padded[:, None] - decoded[None]) ** 2).sum(2)
    got = sum(tables[:, j, :][:, codes[:, j]] for j in range(ivfpq.PARTS))
    assert np.allclose(got, want)


def test_approximate_edge_rows(spark):
    v = vectors(30, 4)
    keys = [None, None, 7, 7, *range(10, 36)]
    docs = frame(spark, keys, v)
    odd = spark.createDataFrame([(90, None, 1, 1.0), (92, [1.0, float("nan"), 0.0, 0.0], 1, 1.0), (93, [1.0], 1, 1.0)], docs.schema)
    assert collected(ivfpq.approximate_top_k(docs.unionAll(odd), k=3)) == brute(keys, v, 3)
    assert ivfpq.approximate_top_k(docs.limit(0)).count() == 0
    assert ivfpq.approximate_top_k(frame(spark, [1], v[:1])).count() == 0
    same = np.ones((60, 3), np.float32)
    assert len(collected(ivfpq.approximate_top_k(frame(spark, list(range(60)), same), k=4))) == 240


def test_groups_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "GROUP_QUERIES", 50)
    monkeypatch.setattr(ivfpq, "GROUP_MEMBERS", 7)
    v = vectors(200, 6)
    keys = list(range(200))
    monkeypatch.setattr(ivfpq, "LEAST_PROBES", 1000)
    assert collected(ivfpq.approximate_top_k(frame(spark, keys, v), k=3, rerank=100)) == brute(keys, v, 3)


def test_approximate_recall_in_long_lists(spark, monkeypatch):
    """Lists of some hundreds to thousands, and equal vectors by neighbor_id."""
    monkeypatch.setattr(ivfpq, "LISTS_PER_ROOT", 0.05)
    v = np.random.default_rng(6).normal(size=(6000, 32)).astype(np.float32)
    v[1000:1500] = v[1000]
    order = np.random.default_rng(7).permutation(len(v))
    docs = frame(spark, order.tolist(), v[order]).repartition(4)
    got = collected(ivfpq.approximate_top_k(docs))
    found = {}
    for key, _, other, _ in got:
        found.setdefault(key, set()).add(other)
    x, hits = v.astype(np.float64), []
    for i in range(0, len(v), 20):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want = np.lexsort((np.arange(len(v)), d))[:10]
        hits.append(len(found[i].intersection(want.tolist())) / 10)
    assert np.mean(hits) >= 0.9
    equal = range(1000, 1500)
    assert all(found[i] == set([j for j in range(1000, 1011) if j != i][:10]) for i in equal)


def test_chosen_queries_ids_of_any_type_and_doubles(spark):
    """Queries are some rows, against all; string ids break ties in their order, nulls last; doubles stay doubles."""
    v = np.round(np.random.default_rng(8).normal(size=(400, 3)), 1)
    v[7] = v[3] + 1e-9
    keys = [None if i % 50 == 9 else f"id {i * 7919 % 400:04d}" for i in range(400)]
    docs = spark.createDataFrame([(k, row.tolist(), i) for i, (k, row) in enumerate(zip(keys, v))], "name string, e array<double>, n int")
    want = []
    for i in range(0, 400, 10):
        d = ((v - v[i]) ** 2).sum(1)
        others = sorted((d[j], keys[j] is None, keys[j] or "") for j in range(400) if j != i)[:4]
        want += [(keys[i], r + 1, None if null else name, round(float(np.sqrt(x)), 6)) for r, (x, null, name) in enumerate(others)]
    got = collected(exact_top_k(docs, k=4, vec_id="name", embedding="e", shard_rows=30, chosen=F.expr("n % 10 = 0")))
    assert got == sorted(want, key=repr)
    near = collected(ivfpq.approximate_top_k(docs, k=4, vec_id="name", embedding="e", chosen=F.expr("n % 10 = 0")))
    assert len(near) == len(want) and recall(near, want) >= 0.9
    assert exact_top_k(docs, vec_id="name", embedding="e", chosen=F.expr("n < 0")).count() == 0
    assert ivfpq.approximate_top_k(docs, vec_id="name", embedding="e", chosen=F.expr("n < 0")).count() == 0
    close = spark.createDataFrame([(1, [1.0]), (2, [1.0 + 1e-9]), (3, [1.0 + 2e-10]), ((1 << 63) - 1, [5.0])], "vec_id long, embedding array<double>")
    assert {(r[0], r[2]) for r in collected(exact_top_k(close, k=1))} == {(1, 3), (2, 3), (3, 1), ((1 << 63) - 1, 2)}


def test_shards_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr("tracewell.llm.kdtree.PASS_LEVELS", 2)
    v = vectors(900, 5, 9)
    v[100:180] = v[100]
    keys = list(range(len(v)))
    assert collected(exact_top_k(frame(spark, keys, v), k=3, shard_rows=12)) == brute(keys, v, 3)


def test_search_opens_no_node_beyond_the_kth_distance():
    v = vectors(2000, 3).astype(np.float64)
    tree = KdTree(v, leaf_rows=10)
    opened = []
    lows = tree.lows

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                opened.append(len(at))
            return np.asarray(self)[at]

    tree.lows = lows.view(Counted)
    ids = np.arange(len(v))
    got = tree.search(v[:50], ids[:50], np.full(50, np.inf), ids, ids, 3)
    assert sum(opened) < 50 * len(tree.span) / 5
    d = ((v[:50, None] - v[None]) ** 2).sum(2)
    d[ids[:50], ids[:50]] = np.inf
    assert (np.sort(got[1].reshape(50, 3), 1) == np.sort(d, 1)[:, :3]).all() or np.allclose(got[1].reshape(50, 3), np.sort(d, 1)[:, :3])
