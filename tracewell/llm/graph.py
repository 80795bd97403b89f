"""Connected components of a large graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge to another, but for the roots themselves: the least of each component.

    ``edges`` has long columns ``a`` and ``b``; self-loops, repeats and nulls are left out.
    Alternates the large-star and small-star contractions until nothing changes; each round is one
    staged table, so neither lineage nor driver memory grows.
    """
    a, b = F.col("a"), F.col("b")
    current = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.select("a", "b").unionAll(current.select(b.alias("a"), a.alias("b")))
        least = F.least(a, F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = F.min("b").over(Window.partitionBy("a"))
        small = (
            large.where(a > b)
            .select("a", "b", least.alias("m"))
            .select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(a != b)
            .distinct()
        )
        current = stage(small, "edges")
        after = _mark(current)
        if after == mark:
            break
        mark = after
    return current.select(a.alias("node"), b.alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge set: equal sets have equal digests."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return tuple(row)
