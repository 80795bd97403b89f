"""Unions of recordings: identity, order, numbering.

A record is identified by (ts_nanos, instance_id, shard_id, phys_offset): the same bytes of the same ring
in two dumps.  Functions take any table that has these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.storage import kept

IDENTITY = ("ts_nanos", "instance_id", "shard_id", "phys_offset")


def union_all(*streams: DataFrame) -> DataFrame:
    """All records of all streams, each with its stream's number (``stream_idx``)."""
    out = None
    for i, stream in enumerate(streams):
        part = stream.withColumn("stream_idx", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no streams")
    return out


def unique(records: DataFrame, order: tuple[str, ...] = ("stream_idx",), identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One record of each identity, that of the first stream.

    Grouping by identity with the least of (order, all other columns) combines before the shuffle, which
    a window can't; ties beyond ``order`` are settled by the other columns, so the result is the same
    however the input lies.
    """
    rest = [c for c in records.columns if c not in identity]
    first = [c for c in order if c in rest]
    packed = F.struct(*[F.col(c) for c in first], *[F.col(c) for c in rest if c not in first])
    out = records.groupBy(*identity).agg(F.min(packed).alias("r"))
    return out.select(*[F.col(c) if c in identity else F.col("r")[c].alias(c) for c in records.columns])


def unique_any(records: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One record of each identity where all that share it are equal, as in successive dumps of one ring."""
    return records.dropDuplicates(list(identity))


def ordered(records: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The merged order of all rings: by time, then instance, shard and offset."""
    return records.orderBy(*keys)


def numbered(records: DataFrame, keys: tuple[str, ...] = IDENTITY, name: str = "seq") -> DataFrame:
    """Dense numbers from 0 in merged order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; a row's number is its place in its partition and the counts of
    all partitions before.  Counts are few (one a partition) and come from the same sorted, checkpointed
    rows, so both steps see one partitioning.
    """
    spark = records.sparkSession
    placed = (
        records.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    placed = kept(placed)
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as there are partitions
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    return placed.join(F.broadcast(before), part == F.col("_p")).withColumn(name, inside + F.col("_before")).drop("_m", "_p", "_before")


def numbered_by_window(records: DataFrame, keys: tuple[str, ...] = IDENTITY, name: str = "seq") -> DataFrame:
    """:func:`numbered` by one window: for small results only, as all rows meet in one task."""
    return records.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))


def survivors(records: DataFrame, size: Column) -> DataFrame:
    """Per (instance, shard): survivors, first and last time, bytes in a ring, and the ring they need."""
    from tracewell.functions.ids import pow2_ceiling

    return (
        records.groupBy("instance_id", "shard_id")
        .agg(F.count(F.lit(1)).alias("records"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"), F.sum(size + 18).alias("ring_bytes"))
        .withColumn("capacity", pow2_ceiling(F.col("ring_bytes")))
    )


def first_of(records: DataFrame, keys: tuple[str, ...], arrival: str, last: bool = False) -> DataFrame:
    """One row a key, the first to arrive (or the last): registries, interns and hosts of several dumps."""
    rest = [c for c in records.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(arrival))
    return records.groupBy(*keys).agg(pick.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
