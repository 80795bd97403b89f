"""What the two vector searches share: usable rows, ids of any type, Arrow to numpy, partial results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import broadcast_if_small, quoted, stage
from tracewell.operators.sets import numbered

#: Stands for a null id where ids decide between equal distances.
LAST = (1 << 63) - 1
FOUND = "uid long, key long, best array<struct<distance: double, key: long, uid: long>>"


@dataclass
class Vectors:
    """Staged rows (uid, key, v, asked); ``names`` has the id of each key where keys aren't the ids themselves."""

    rows: DataFrame
    n: int
    dim: int
    kind: T.DataType
    names: DataFrame | None = None

    def ids(self, found: DataFrame, *columns: str) -> DataFrame:
        """``found`` with the keys in the columns named turned back into ids."""
        for c in columns:
            if self.names is None:
                found = found.withColumn(c, F.when(F.col(c) != LAST, F.col(c)).cast(self.kind))
            else:
                found = found.join(broadcast_if_small(self.names.withColumnRenamed("key", c)), c, "left").drop(c).withColumnRenamed("name", c)
        return found


def usable(df: DataFrame, vec_id: str, embedding: str, chosen: Column | None = None) -> Vectors:
    """The rows that can be compared; ``asked`` marks those that ``chosen`` holds for (all by default).

    Elements are compared as doubles, or as floats where that is their type.  Left out are null vectors,
    those with a null, infinite or NaN element, and those of another length than most have (the longer
    length if two are as frequent).  Keys are numbers in the order of the ids, nulls last: whole numbers
    are their own keys, ids of other types get theirs by sorting the distinct ones.
    """
    element = getattr(df.schema[embedding].dataType, "elementType", None)
    kind = "float" if isinstance(element, T.FloatType) else "double"
    v = F.transform(quoted(embedding), lambda x: x.cast(kind))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ask = F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False))
    rows = df.select(quoted(vec_id).alias("name"), v.alias("v"), ask.alias("asked")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    of = df.schema[vec_id].dataType
    whole = isinstance(of, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    names = None
    if whole and not (isinstance(of, T.LongType) and rows.where(F.col("name") == LAST).limit(1).count()):
        rows = rows.select(F.coalesce(F.col("name").cast("long"), F.lit(LAST)).alias("key"), "v", "asked")
    else:
        names = stage(numbered(rows.select("name").where("name is not null").distinct(), ("name",), "key"), "names").select("key", "name")
        rows = rows.join(broadcast_if_small(names), "name", "left").select(F.coalesce("key", F.lit(LAST)).alias("key"), "v", "asked")
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n, dim = (int(sizes[1]), int(sizes[0])) if sizes else (0, 0)
    return Vectors(rows.where(F.size("v") == dim).select("uid", "key", "v", "asked"), n, dim, of, names)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, pair by pair, from their differences (no cancellation)."""
    out = np.empty(len(a))
    for i in range(0, len(a), 32_768):
        d = a[i : i + 32_768] - b[i : i + 32_768]
        out[i : i + 32_768] = np.einsum("ij,ij->i", d, d)
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by a product of matrices; exact to about 1e-12 of the norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def firsts(owner: np.ndarray, distance: np.ndarray, key: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each owner by (distance, key, uid), in that order."""
    order = np.lexsort((uid, key, distance, owner))
    o = owner[order]
    begin = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1]) if len(o) else np.empty(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(begin, np.diff(np.append(begin, len(o))))
    return order[rank < k]


def result_batch(uids: np.ndarray, keys: np.ndarray, owner: np.ndarray, distance: np.ndarray, key: np.ndarray, uid: np.ndarray) -> pa.Table:
    """FOUND rows of queries 0..n-1 whose finds are sorted by ``owner``."""
    offsets = np.searchsorted(owner, np.arange(len(uids) + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), pa.array(key, pa.int64()), pa.array(uid, pa.int64())], ["distance", "key", "uid"])
    return pa.table({"uid": pa.array(uids, pa.int64()), "key": pa.array(keys, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(offsets), inner)})


def nothing_found() -> pa.Table:
    return result_batch(*[np.empty(0, np.int64)] * 3, np.empty(0), *[np.empty(0, np.int64)] * 2)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """FOUND rows, one a query: the k first of all its partial results."""
    return found.groupBy("uid", "key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def ranked(best: DataFrame, vectors: Vectors, vec_id: str) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) of FOUND rows, one a query."""
    flat = best.select("key", F.posexplode("best").alias("p", "b"))
    out = flat.select(F.col("key").alias("q_key"), (F.col("p") + 1).cast("int").alias("rank"), F.col("b.key").alias("n_key"), F.round(F.sqrt("b.distance"), 6).alias("distance"))
    out = vectors.ids(out, "q_key", "n_key")
    return out.select(F.col("q_key").alias(vec_id), "rank", F.col("n_key").alias("neighbor_id"), "distance")


def pieces(queries: DataFrame, members: DataFrame, key: str, most_queries: int, most_members: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``piece``, cut so that no group of (key, piece) exceeds the bounds.

    A key with many members is cut into parts that each see all its queries, one with many queries into
    parts that each see all its members; every pair meets exactly once.
    """
    m = members.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    q = queries.groupBy(key).agg(F.count(F.lit(1)).alias("q"))
    cut = m.join(q, key).select(key, F.ceil(F.col("m") / most_members).cast("int").alias("mp"), F.ceil(F.col("q") / most_queries).cast("int").alias("qp"))
    cut = broadcast_if_small(stage(cut, "pieces"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = F.pmod(F.xxhash64(F.lit(3), "uid"), F.col("mp").cast("long")).cast("int")
    theirs = F.pmod(F.xxhash64(F.lit(4), "uid"), F.col("qp").cast("long")).cast("int")
    left = queries.join(cut, key).withColumn("part", spread("mp")).withColumn("piece", theirs * F.col("mp") + F.col("part")).drop("mp", "qp", "part")
    right = members.join(cut, key).withColumn("part", spread("qp")).withColumn("piece", F.col("part") * F.col("mp") + mine).drop("mp", "qp", "part")
    # both may come from one table: new columns, so that a cogroup can tell them apart
    return left.select(*[F.col(c).alias(c) for c in left.columns]), right
