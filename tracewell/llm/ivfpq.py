"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BROADCAST_BYTES, broadcast_if_small, discard, stage
from tracewell.llm.vectors import FOUND, Vectors, best_of, distances, firsts, matrix, nothing_found, pieces, ranked, result_batch, squared, usable

K = 10
#: Inverted lists: this many times the root of the number of vectors, and no more than centers fit in a broadcast.
LISTS_PER_ROOT = 1.0
#: Vectors (picked by hash) that centers and codebooks are fitted on: so many for each list, and so many at least.
FIT_PER_LIST, FIT_LEAST = 64, 65_536
#: Share of the true neighbours that the visited lists must hold; as many lists are visited as that takes,
#: measured by brute force for so many vectors, and LEAST_PROBES at least.
RECALL, MEASURED, LEAST_PROBES = 0.96, 512, 4
#: Parts of a residual with a code of one byte each, and codes of a part.
PARTS, CODES = 8, 256
ROUNDS = 6
#: Candidates of a query that are reranked by their exact distance at least, for each result wanted.
RERANK = 6
#: Share of the true neighbours that may be lost in visited lists by not being reranked.
LOST = 0.01
#: Lists that a query has visited after each turn but the last.
TURNS = (4, 32)
GROUP_QUERIES, GROUP_MEMBERS = 16_384, 262_144


def _nearest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(v), np.int64)
    for a in range(0, len(v), 4096):
        out[a : a + 4096] = squared(v[a : a + 4096], centers).argmin(1)
    return out


def _lloyd(rows: DataFrame, sets: list[np.ndarray], dim: int, cut, rounds: int) -> list[np.ndarray]:
    """Lloyd's iterations for one or more codebooks at once, each over all of ``rows``.

    ``cut`` makes of a matrix of vectors the matrices that the codebooks quantise.  Each round is one
    distributed pass that adds up, per codebook and center, the vectors nearest to it; a center that
    nothing is nearest to stays where it was.
    """
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(sets)

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sets = shared.value
            sums = [np.zeros((len(c), c.shape[1] + 1)) for c in sets]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for j, x in enumerate(cut(matrix(batch.column(0), dim))):
                    near = _nearest(x, sets[j])
                    order = np.argsort(near, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) != 0]))
                    sums[j][near[order][starts], :-1] += np.add.reduceat(x[order], starts, axis=0)
                    sums[j][:, -1] += np.bincount(near, minlength=len(sets[j]))
            for j, total in enumerate(sums):
                some = np.flatnonzero(total[:, -1])
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), j, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["book", "center", "total"]
                    )

        added = rows.select("v").mapInArrow(part, "book int, center int, total array<double>")
        width = max(c.shape[1] for c in sets) + 1
        sums = added.groupBy("book", "center").agg(F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
        sets = [c.copy() for c in sets]
        for r in sums.toLocalIterator():
            total = np.array([x for x in r.total if x is not None])
            sets[r.book][r.center] = total[:-1] / total[-1]
        shared.unpersist()
    return sets


def _starts(rows: DataFrame, n: int) -> np.ndarray:
    """n vectors to start from, those of least hash."""
    return np.array([list(r.v) for r in rows.orderBy(F.xxhash64(F.lit(11), "v", "uid")).limit(n).select("v").toLocalIterator()], np.float64)


class Quantizer:
    """Coarse centers and the codebooks of residuals, of at most BROADCAST_BYTES."""

    def __init__(self, centers: np.ndarray, dim: int) -> None:
        self.centers, self.dim = centers, dim
        self.width = math.ceil(dim / PARTS)
        self.books: list[np.ndarray] = []

    def cut(self, residuals: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros((len(residuals), self.width * PARTS))
        padded[:, : self.dim] = residuals
        return [padded[:, j * self.width : (j + 1) * self.width] for j in range(PARTS)]

    def encode(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One byte for each part, as a long."""
        codes = np.stack([_nearest(x, b) for x, b in zip(self.cut(v - self.centers[lists]), self.books)], 1).astype(np.uint8)
        return np.ascontiguousarray(codes).view(np.int64).ravel()

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        codes = split(codes)
        return self.centers[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)[:, : self.dim]

    def tables(self, queries: np.ndarray, center: int) -> np.ndarray:
        """(query, part, code): squared distance of the query's residual to each code of each part."""
        return np.stack([squared(x, b) for x, b in zip(self.cut(queries - self.centers[center]), self.books)], 1)


def split(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes, np.int64).view(np.uint8).reshape(-1, PARTS)


def lists_for(n: int, dim: int) -> int:
    """With more vectors than centers fit in a broadcast, lists get longer; long ones are searched in pieces."""
    return max(1, min(n, round(LISTS_PER_ROOT * math.sqrt(n)), BROADCAST_BYTES // (8 * dim)))


def train(rows: DataFrame, n: int, dim: int, rounds: int = ROUNDS) -> Quantizer:
    """Coarse centers, then codebooks of the residuals, fitted on a sample of FIT_PER_LIST vectors a list."""
    lists = lists_for(n, dim)
    share = max(FIT_LEAST, FIT_PER_LIST * lists) / n
    if share < 1:
        rows = stage(rows.where(F.pmod(F.xxhash64(F.lit(10), "uid"), F.lit(1 << 30)) < int(share * (1 << 30))), "fit")
    starts = _starts(rows, lists)
    (centers,) = _lloyd(rows, [starts], dim, lambda v: [v], rounds)
    quantizer = Quantizer(centers, dim)
    first = _starts(rows, min(CODES, n))
    residuals = quantizer.cut(first - centers[_nearest(first, centers)])
    quantizer.books = _lloyd(rows, [x.copy() for x in residuals], dim, lambda v: quantizer.cut(v - centers[_nearest(v, centers)]), rounds)
    return quantizer


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be in a result: of more than k + 1 equal vectors, the first k + 1 by (key, uid)."""
    same = F.xxhash64("v")
    heavy = stage(rows.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1), "heavy")
    if not heavy.limit(1).count():
        return rows
    # a hot vector's rows are first cut to k + 1 in salted parts
    some = rows.withColumn("same", same).join(broadcast_if_small(heavy), "same")
    salt = F.pmod(F.xxhash64(F.lit(8), "uid"), F.ceil(F.col("n") / GROUP_MEMBERS))
    first = lambda c: F.slice(F.array_sort(c), 1, k + 1).alias("first")
    parts = some.groupBy("v", salt.alias("salt")).agg(first(F.collect_list(F.struct("key", "uid"))))
    kept = stage(parts.groupBy("v").agg(first(F.flatten(F.collect_list("first")))).select(F.explode("first.uid").alias("uid")), "firsts")
    surplus = some.select("uid").join(kept, "uid", "left_anti")
    return rows.join(surplus, "uid", "left_anti")


def _calibrated(table: Vectors, members: DataFrame, quantizer: Quantizer, k: int, recall: float, rerank: int) -> tuple[int, int]:
    """Lists to visit, and candidates of a query to rerank (``rerank * k`` at least).

    Measured by brute force for MEASURED vectors: the lists visited hold ``recall`` of their true
    neighbours, and all but LOST of those are among the candidates reranked.
    """
    lists, dim = len(quantizer.centers), table.dim
    asked = [(r.uid, list(r.v)) for r in table.rows.orderBy(F.xxhash64(F.lit(13), "v", "uid")).limit(MEASURED).select("uid", "v").toLocalIterator()]
    own, v = np.array([u for u, _ in asked]), np.array([x for _, x in asked], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            points, uid, key = matrix(batch.column(2), dim), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            d = squared(v, points)
            d[own[:, None] == uid] = np.inf
            take = min(k, len(points))
            row, p = np.nonzero(d <= np.partition(d, take - 1, axis=1)[:, take - 1 : take])
            joined = [np.concatenate(x) for x in zip(best, (row, d[row, p], key[p], uid[p]))]
            on = firsts(*joined, k)
            best = tuple(x[on] for x in joined)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["q", "d", "key", "uid"])

    found = table.rows.select("uid", "key", "v").mapInArrow(nearest, "q long, d double, key long, uid long").where("d < double('inf')")
    first = lambda c: F.slice(F.array_sort(c), 1, k).alias("best")
    found = found.groupBy("q", F.pmod("uid", F.lit(64)).alias("salt")).agg(first(F.collect_list(F.struct("d", "key", "uid")))).groupBy("q").agg(first(F.flatten(F.collect_list("best"))))
    truth = stage(found.select("q", F.explode("best.uid").alias("uid")), "truth")
    near = members.join(F.broadcast(truth), "uid").select("q", "list", "codes").collect()  # MEASURED * k rows
    if not near:
        return lists, rerank * k
    q, of, codes = np.array([tuple(r) for r in near], np.int64).T
    rough = distances(v[q], quantizer.decode(codes, of))
    rank = np.argsort(np.argsort(squared(v, quantizer.centers), axis=1), axis=1)
    probes = min(lists, max(LEAST_PROBES, math.ceil(np.quantile(rank[q, of] + 1, recall))))
    visited = rank < probes
    inside = visited[q, of]
    order = np.lexsort((rough[inside], q[inside]))
    q, rough = q[inside][order], rough[inside][order]
    bounds = np.searchsorted(q, np.arange(len(v) + 1))

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each neighbour, the members of visited lists whose codes are as near to the query as its own."""
        counts = np.zeros(len(rough) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy()
            d = squared(v, quantizer.decode(batch.column(1).to_numpy(), of))
            for i in range(len(v)):
                a, b = bounds[i], bounds[i + 1]
                if b > a:
                    # the first of the query's neighbours that is not nearer than the member
                    at = np.searchsorted(rough[a:b] * (1 + 1e-9), d[i][visited[i, of]])
                    counts[a:b] += np.cumsum(np.bincount(at, minlength=b - a + 1)[: b - a])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["i", "n"])

    nearer = np.ones(len(rough), np.int64)
    for r in members.select("list", "codes").mapInArrow(before, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        nearer[r.i] = r.n
    nearer.sort()
    return probes, max(rerank * k, int(nearer[min(len(nearer), math.ceil((1 - LOST) * len(nearer))) - 1])) if len(nearer) else rerank * k


def search_list(
    quantizer: Quantizer, center: int, v: np.ndarray, own: np.ndarray, limit: np.ndarray, codes: np.ndarray, key: np.ndarray, uid: np.ndarray, most: int
) -> tuple[np.ndarray, ...]:
    """The ``most`` first members of a list for each query by asymmetric distance, none beyond its limit."""
    out = []
    codes = split(codes)
    for a in range(0, len(v), 256):
        tables = quantizer.tables(v[a : a + 256], center)
        rough = np.zeros((len(tables), len(codes)))
        for j in range(PARTS):
            rough += tables[:, j, :][:, codes[:, j]]
        near = rough <= limit[a : a + 256, None]
        if most < len(codes):
            near &= rough <= np.partition(rough, most, axis=1)[:, most : most + 1]  # one more: the query itself may be there
        row, p = np.nonzero(near)
        on = uid[p] != own[a + row]
        row, p = row[on], p[on]
        best = firsts(row, rough[row, p], key[p], uid[p], most)
        out.append((row[best] + a, rough[row[best], p[best]], key[p[best]], uid[p[best]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def approximate_top_k(
    vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, rerank: int = RERANK, chosen: Column | None = None
) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every query k near others, by Euclidean distance.

    Queries are the rows that ``chosen`` (a condition on the columns of ``vectors``) holds for, all rows by
    default.  Every row is in the list of its nearest coarse center, with its residual as product-quantised
    codes.  A query visits the lists of the centers nearest to it, nearest first, in turns; in each it adds up
    its distances to the members' codes (one table of distances for each part of the residual) and keeps one
    shortlist over all lists, whose last distance is the limit of the next turn.  The shortlist is reranked
    once by exact distance; ties go by neighbor_id, nulls last.  The number of lists is that with which
    ``recall`` of the true neighbours are in a visited one, the length of the shortlist that with which all
    but LOST of those are on it, ``rerank * k`` at least; both are measured by brute force for MEASURED
    vectors.  At the defaults at least 0.9 of the true neighbours are found (tests measure it).  Centers and
    codebooks are fitted on a sample of max(FIT_LEAST, FIT_PER_LIST * lists) vectors, picked by hash.

    Rows that can't be compared, equal ids and vectors, ids of any type, few or no rows and other columns are
    dealt with as by :func:`tracewell.llm.kdtree.exact_top_k`.
    """
    spark = vectors.sparkSession
    table = usable(vectors, vec_id, embedding, chosen)
    dim = table.dim
    if not table.n:
        return ranked(spark.createDataFrame([], FOUND), table, vec_id)
    quantizer = train(table.rows.select("uid", "v"), table.n, dim)
    lists = len(quantizer.centers)
    shared = spark.sparkContext.broadcast(quantizer)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(2), dim)
                near = _nearest(v, q.centers)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near), pa.array(q.encode(v, near))], names=["uid", "key", "list", "codes"])

    members = stage(_candidates(table.rows, k).select("uid", "key", "v").mapInArrow(assign, "uid long, key long, list long, codes long"), "lists")
    probes, most = _calibrated(table, members, quantizer, k, recall, rerank)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                order = np.argsort(squared(matrix(part.column(1), dim), q.centers), axis=1, kind="stable")[:, :probes]
                turn = np.searchsorted(np.array(TURNS), np.arange(order.shape[1]), "right")
                again = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), pa.array(np.ascontiguousarray(order).ravel()), pa.array(np.tile(turn, part.num_rows))], names=["uid", "list", "turn"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing_found()
        uid, key, v = left["uid"].to_numpy(), left["key"].to_numpy(), matrix(left["v"], dim)
        best = search_list(shared.value, left["list"][0].as_py(), v, uid, left["limit"].to_numpy(), right["codes"].to_numpy(), right["key"].to_numpy(), right["uid"].to_numpy(), most)
        return result_batch(uid, key, *best)

    asked = table.rows.where("asked").select("uid", "key", "v")
    visits = stage(asked.select("uid", "v").mapInArrow(route, "uid long, list long, turn long"), "visits")
    found = None
    for turn in range(1 + sum(t < probes for t in TURNS)):
        queries = asked.join(visits.where(F.col("turn") == turn).drop("turn"), "uid")
        if found is None:
            queries = queries.withColumn("limit", F.lit(float("inf")))
        else:
            full = F.when(F.size("best") >= most, F.element_at("best", -1)["distance"])
            queries = queries.join(found.select("uid", full.alias("limit")), "uid", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        left, right = pieces(queries, members, "list", GROUP_QUERIES, GROUP_MEMBERS)
        more = left.groupBy("list", "piece").cogroup(right.groupBy("list", "piece")).applyInArrow(search, FOUND).where(F.size("best") > 0)
        before, found = found, stage(best_of(more if found is None else found.unionAll(more), most), "shortlists")
        if before is not None:
            discard(before)
    pairs = found.select(F.col("uid").alias("q"), F.explode("best").alias("b")).select("q", "b.uid")
    mine = asked.select(F.col("uid").alias("q"), F.col("key").alias("q_key"), F.col("v").alias("q_v"))
    both = pairs.join(table.rows.select("uid", "key", "v"), "uid").join(mine, "q").select("q", "q_key", "uid", "key", "q_v", "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(4), dim), matrix(batch.column(5), dim)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d)], names=["q", "q_key", "uid", "key", "distance"])

    reranked = both.mapInArrow(exact, "q long, q_key long, uid long, key long, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "key", "uid"))), 1, k)
    return ranked(reranked.groupBy(F.col("q").alias("uid"), F.col("q_key").alias("key")).agg(best.alias("best")), table, vec_id)
