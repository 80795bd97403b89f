"""Exact nearest neighbours by KD-trees over spatial shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, discard, stage
from tracewell.llm.vectors import FOUND, best_of, distances, firsts, matrix, nothing_found, pieces, ranked, result_batch, squared, usable

K = 10
#: Vectors a shard has at most, unless they are equal.
SHARD_ROWS = 16_384
LEAF_ROWS = 96
#: Queries that go through a tree together.
BLOCK_QUERIES = 512
#: Queries that visit a shard in one group.
VISIT_ROWS = 32_768
#: Levels of median splits that one pass makes, and vectors of a shard (picked by hash) that its medians come
#: from.  They only place the cuts: boxes and searches see all vectors.
PASS_LEVELS, CUT_SAMPLE = 6, 4096


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to the box in the same row."""
    gap = np.maximum(low - queries, 0) + np.maximum(queries - high, 0)
    return np.einsum("ij,ij->i", gap, gap)


class KdTree:
    """Median splits of the widest side down to leaves; each node has the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int]] = []
        work = [(0, len(points), -1, 0)] if len(points) else []
        while work:
            a, b, parent, side = work.pop()
            node, mine = len(self.span), points[self.order[a:b]]
            self.low.append(mine.min(0))
            self.high.append(mine.max(0))
            self.span.append((a, b))
            self.child.append((-1, -1))
            if parent >= 0:
                pair = self.child[parent]
                self.child[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            width = self.high[-1] - self.low[-1]
            if b - a > leaf_rows and width.max() > 0:
                axis, half = int(width.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(mine[:, axis], half)]
                work += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.lows, self.highs = (np.array(self.low), np.array(self.high)) if self.span else (np.empty((0, 0)),) * 2
        self.children = np.array(self.child, np.int64).reshape(-1, 2)
        self.reach = float(np.abs(points).max(initial=0))

    def search(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, key: np.ndarray, uid: np.ndarray, k: int):
        """The k nearest points of each query within its limit, as (query, distance, key, uid) sorted by query.

        ``own`` is the uid of the query, which isn't its own neighbour.
        """
        if not len(queries) or not self.span:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        parts = []
        for a in range(0, len(queries), BLOCK_QUERIES):
            who = slice(a, a + BLOCK_QUERIES)
            found = self._search_block(queries[who], own[who], limit[who], key, uid, k)
            parts.append((found[0] + a, *found[1:]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search_block(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, key: np.ndarray, uid: np.ndarray, k: int):
        """:meth:`search` for some queries, all of them one step at a time.

        Best first: each step takes every query to the node of least bound among those open to it.  An
        inner node opens its two children, a leaf is compared point by point; nodes beyond the kth distance
        so far are never opened, and a query is done when its least bound is.
        """
        limit = limit.copy()
        bounds = np.full((len(queries), len(self.span)), np.inf)
        bounds[:, 0] = box_bounds(queries, self.lows[:1], self.highs[:1])
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        slack = 1e-11 * (self.reach + float(np.abs(queries).max(initial=0))) ** 2 * queries.shape[1]
        live = np.arange(len(queries))
        while len(live):
            node = bounds[live].argmin(1)
            least = bounds[live, node]
            on = np.isfinite(least) & (least <= limit[live])
            live, node = live[on], node[on]
            bounds[live, node] = np.inf
            inner = self.children[node, 0] >= 0
            q, c = np.repeat(live[inner], 2), self.children[node[inner]].ravel()
            b = box_bounds(queries[q], self.lows[c], self.highs[c])
            near = b <= limit[q]
            bounds[q[near], c[near]] = b[near]
            by = np.argsort(node[~inner], kind="stable")
            who_of, leaf = live[~inner][by], node[~inner][by]
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else []
            new_rows, new_points = [], []
            for i, a in enumerate(cuts):
                who = who_of[a : cuts[i + 1] if i + 1 < len(cuts) else len(who_of)]
                first, last = self.span[leaf[a]]
                members = self.order[first:last]
                r, c = np.nonzero(squared(queries[who], self.points[members]) <= limit[who][:, None] + slack)
                new_rows.append(who[r])
                new_points.append(members[c])
            if not new_rows:
                continue
            r, p = np.concatenate(new_rows), np.concatenate(new_points)
            on = uid[p] != own[r]
            r, p = r[on], p[on]
            d = distances(queries[r], self.points[p])
            on = d <= limit[r]
            r, p, d = r[on], p[on], d[on]
            touched = np.zeros(len(queries), bool)
            touched[r] = True
            old = touched[best[0]]
            joined = [np.concatenate([x[old], y]) for x, y in zip(best, (r, d, key[p], uid[p]))]
            keep = firsts(*joined, k)
            joined = [x[keep] for x in joined]
            best = tuple(np.concatenate([x[~old], y]) for x, y in zip(best, joined))
            counts = np.bincount(joined[0], minlength=len(queries))
            full = np.flatnonzero(counts == k)
            # ``joined`` is sorted by query, so the kth of a full one is its last
            limit[full] = np.minimum(limit[full], joined[1][np.cumsum(counts)[full] - 1])
        order = firsts(*best, k)
        return tuple(x[order] for x in best)


def _cuts(points: np.ndarray, levels: int) -> tuple[list[int], list[float]]:
    """Axis and value of each median split, as a heap from place 1 on; -1 where points don't differ."""
    axes, values = [-1] * (1 << levels), [0.0] * (1 << levels)
    work = [(1, points)]
    while work:
        node, mine = work.pop()
        if node >= 1 << levels or not len(mine):
            continue
        axis = int((mine.max(0) - mine.min(0)).argmax())
        side = np.sort(mine[:, axis])
        if side[0] == side[-1]:
            continue
        middle = side[(len(side) - 1) // 2]
        cut = middle if middle < side[-1] else side[np.searchsorted(side, middle) - 1]
        axes[node], values[node] = axis, float(cut)
        left = mine[:, axis] <= cut
        work += [(2 * node, mine[left]), (2 * node + 1, mine[~left])]
    return axes, values


def _shards(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """(uid, key, v, asked, shard): split at medians of the widest side.

    Each pass splits every shard that is too large, by up to PASS_LEVELS levels at once; a shard's parent is
    its number without the last PASS_LEVELS bits.  Shards of equal vectors stay as large as they are.
    """
    spread = 1 << PASS_LEVELS
    current = stage(rows.select("uid", "key", "v", "asked", F.lit(1).cast("long").alias("shard")), "shards")
    schema = current.schema

    def cut(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        levels = min(PASS_LEVELS, max(1, math.ceil(math.log2(n / most))))
        axes, values = _cuts(matrix(table["v"], dim), levels)
        some = [table["shard"][0].as_py()] if axes[1] >= 0 else []
        return pa.table({"shard": pa.array(some, pa.int64()), "axes": pa.array([axes] * len(some), pa.list_(pa.int32())), "cuts": pa.array([values] * len(some), pa.list_(pa.float64()))})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(4).to_numpy()
            to = shard.copy()
            axes, cuts = batch.column(5), batch.column(6)
            v = matrix(batch.column(2), dim) if batch.num_rows else None
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                if not axes[int(mine[0])].is_valid:
                    continue
                axis, at = np.array(axes[int(mine[0])].as_py()), np.array(cuts[int(mine[0])].as_py())
                node = np.ones(len(mine), np.int64)
                for _ in range(len(axis).bit_length() - 1):
                    on = axis[node]
                    # where the sample had nothing to split, all go left
                    node = 2 * node + ((on >= 0) & (v[mine, on] > at[node]))
                to[mine] = s * spread + node - len(axis)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(to)], schema=_arrow(batch, schema.names))

    while True:
        large = stage(current.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large")
        chance = F.least(F.lit(1.0), F.lit(float(CUT_SAMPLE)) / F.col("n"))
        sample = current.join(broadcast_if_small(large), "shard").where(F.pmod(F.xxhash64(F.lit(9), "uid"), F.lit(1 << 30)) < chance * (1 << 30))
        cuts = stage(sample.select("shard", "v", "n").groupBy("shard").applyInArrow(cut, "shard long, axes array<int>, cuts array<double>"), "cuts")
        if not cuts.limit(1).count():
            return current
        moved = current.join(broadcast_if_small(cuts), "shard", "left").select(*schema.names, "axes", "cuts").mapInArrow(route, schema)
        before, current = current, stage(moved, "shards")
        discard(before, large, cuts)


def _arrow(batch: pa.RecordBatch, names: list[str]) -> pa.Schema:
    return pa.schema([pa.field(n, batch.schema.field(n).type) for n in names])


def _nodes(sharded: DataFrame, dim: int) -> DataFrame:
    """(parent, uid, leaf, low, high): the tight box of every shard and of all shards under each ancestor."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, v = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            order = np.argsort(shard, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
            low, high = (list(f.reduceat(v[order], starts, axis=0)) for f in (np.minimum, np.maximum))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][starts]), pa.array(low, kind), pa.array(high, kind)], names=["shard", "low", "high"])

    boxes = sharded.select("shard", "v").mapInArrow(part, "shard long, low array<double>, high array<double>")
    sides = boxes.select("shard", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s")).groupBy("shard", "i").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    levels = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i > 0).alias("inner"), F.call_function("shiftright", F.col("shard"), (i * PASS_LEVELS).cast("int")).alias("node"))), lambda x: x["node"] > 0)
    up = sides.select(F.explode(levels).alias("l"), "i", "low", "high").groupBy("l.node", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("l.inner").alias("inner"))
    whole = up.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("s"), F.first("inner").alias("inner"))
    return stage(whole.select(F.shiftright("node", PASS_LEVELS).alias("parent"), F.col("node").alias("uid"), (~F.col("inner")).alias("leaf"), F.col("s.low").alias("low"), F.col("s.high").alias("high")), "nodes")


def _visits(asked: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(uid, shard, bound): the shards besides its own whose box is within a query's limit.

    Goes down the hierarchy of boxes level by level, leaving out whatever lies under a box beyond the limit.
    """
    kind = asked.schema["v"].dataType.simpleString()
    schema = f"uid long, shard long, limit double, v {kind}, parent long, leaf boolean, bound double"

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        v, limit = matrix(left["v"], dim), left["limit"].to_numpy()
        names = ["uid", "shard", "limit", "v", "parent", "leaf", "bound"]
        parts = [left.slice(0, 0).select(names[:4]).append_column("parent", pa.array([], pa.int64())).append_column("leaf", pa.array([], pa.bool_())).append_column("bound", pa.array([], pa.float64()))]
        for node, leaf, low, high in zip(right["uid"].to_pylist(), right["leaf"].to_pylist(), right["low"].to_pylist(), right["high"].to_pylist()):
            bound = box_bounds(v, np.array(low)[None], np.array(high)[None])
            on = np.flatnonzero(bound <= limit)
            got = left.take(pa.array(on)).select(names[:4])
            for name, column in (("parent", pa.array(np.full(len(on), node))), ("leaf", pa.array(np.full(len(on), leaf))), ("bound", pa.array(bound[on]))):
                got = got.append_column(name, column)
            parts.append(got)
        return pa.concat_tables(parts)

    at, out = asked.select("uid", "shard", "limit", "v", F.least(F.col("shard"), F.lit(1).cast("long")).alias("parent")), None
    while True:
        left, right = pieces(at, nodes.where("uid != parent"), "parent", VISIT_ROWS, 1 << 20)
        got = stage(left.groupBy("parent", "piece").cogroup(right.groupBy("parent", "piece")).applyInArrow(expand, schema), "frontier")
        leaves = got.where("leaf and parent != shard").select("uid", F.col("parent").alias("shard"), "bound")
        out = leaves if out is None else out.unionAll(leaves)
        at = got.where("not leaf").select("uid", "shard", "limit", "v", "parent")
        if not at.limit(1).count():
            return out


def exact_top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, chosen: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every query its k nearest others, by Euclidean distance.

    Queries are the rows that ``chosen`` (a condition on the columns of ``vectors``) holds for, all rows by
    default; each is compared to all rows.  Vectors are put into shards by median splits, and a KD-tree is
    built in each.  A query goes to its own shard first; its kth distance so far decides which other shards'
    tight boxes, met on the way down a hierarchy of boxes, may hold nearer ones.  Those are visited in order
    of their bounds: one, then two, then four more and so on, each turn with the kth distance that the turn
    before left.  Equal distances are ordered by neighbor_id, nulls last.  Distances are rounded to six digits.

    Rows that can't be compared (null vector; null, NaN or infinite element; another length than most)
    have no neighbours and are none.  A row isn't its own neighbour, but rows with equal ids or vectors
    are each other's.  Ids may be of any type that can be ordered.  A table of fewer than k others gives as
    many as there are; an empty one, or one without queries, no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    table = usable(vectors, vec_id, embedding, chosen)
    dim = table.dim
    if not table.n:
        return ranked(spark.createDataFrame([], FOUND), table, vec_id)
    sharded = _shards(table.rows, dim, shard_rows)
    asked = sharded.where("asked").drop("asked")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing_found()
        uid, key = left["uid"].to_numpy(), left["key"].to_numpy()
        best = KdTree(matrix(right["v"], dim)).search(matrix(left["v"], dim), uid, left["limit"].to_numpy(), right["key"].to_numpy(), right["uid"].to_numpy(), k)
        return result_batch(uid, key, *best)

    def searched(queries: DataFrame) -> DataFrame:
        left, right = pieces(queries, sharded.select("uid", "key", "v", "shard"), "shard", VISIT_ROWS, shard_rows * 4)
        return left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInArrow(visit, FOUND)

    found = stage(best_of(searched(asked.withColumn("limit", F.lit(float("inf")))), k), "found")
    if sharded.select("shard").distinct().limit(2).count() < 2:
        return ranked(found, table, vec_id)
    kth = F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).otherwise(float("inf"))
    limits = lambda found: found.select("uid", kth.alias("limit"))
    visits = _visits(asked.join(limits(found), "uid"), _nodes(sharded, dim), dim)
    # as many rows a query as there are shards within its first kth distance
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("bound", "shard"))
    visits = stage(visits.withColumn("turn", F.floor(F.log2(rank)).cast("int")), "visits")
    last = visits.agg(F.max("turn")).first()[0]
    for turn in range(0 if last is None else last + 1):
        open_to = visits.where(F.col("turn") == turn).join(limits(found), "uid").where("bound <= limit")
        queries = open_to.join(asked.select("uid", "key", "v"), "uid").select("uid", "key", "v", "shard", "limit")
        before, found = found, stage(best_of(found.unionAll(searched(queries).where(F.size("best") > 0)), k), "found")
        discard(before)
    return ranked(found, table, vec_id)


#: What the registered queries ask for: every hundredth id, against all rows.
HUNDREDTH = "vec_id % 100 = 0"
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT a.u, a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d,
         row_number() OVER (PARTITION BY a.u ORDER BY list_distance(a.e, b.e), b.vec_id) AS r
  FROM v a JOIN v b ON a.u <> b.u
  WHERE a.vec_id % 100 = 0
)
SELECT vec_id, CAST(r AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM p WHERE r <= 10
"""
