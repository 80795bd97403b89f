"""Two-pass external shuffle of a corpus into training shards."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import fresh, hashable, quoted, total_bytes


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of ``range(n)``: swap each place, last first, with one not after it."""
    order = list(range(n))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def shuffled_bucket(table: pa.Table, seed: int, bucket: int, sort_key: str) -> pa.Table:
    """The bucket's rows in canonical order, then permuted by a generator of (seed, bucket)."""
    canonical = np.argsort(table[sort_key].to_numpy(), kind="stable")
    return table.take(pa.array(canonical[fisher_yates(len(canonical), np.random.default_rng([seed, bucket]))]))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(hashes: np.ndarray, seen: Counter, part: int) -> np.ndarray:
    """The hashes of rows, each mixed with the part of the input it is in and its number among equal ones there.

    Equal rows so get hashes of their own.  Which of them gets which doesn't matter, so a part that is read
    again in another order has the same rows with the same hashes.
    """
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    many = np.diff(np.append(starts, len(h)))
    number = np.arange(len(h)) - np.repeat(starts, many)
    for s, n in zip(starts.tolist(), many.tolist()):
        if before := seen[int(h[s])]:
            number[s : s + n] += before
        seen[int(h[s])] += n
    out = np.empty(len(h), np.uint64)
    out[order] = mixed(h.view(np.uint64) ^ mixed(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + 1)))
    return out


def external_shuffle(docs: DataFrame, seed: int = 17, bucket_bytes: int = 48 << 20, slice_rows: int = 4096) -> DataFrame:
    """Every row of ``docs`` in a uniformly random order, as shards of about ``bucket_bytes``.

    Pass one scatters rows into ``ceil(bytes / bucket_bytes)`` buckets by a seeded hash of the whole
    row, of the part of the input that it is in, and of its number among equal rows there; pass two puts
    each bucket into an order fixed by a second hash, so that a task which runs again after a lost executor
    gives the same rows, and Fisher-Yates shuffles it.  Returns the columns of ``docs`` and ``shard`` (int),
    ``position`` (long, from 0 within the shard); read by (shard, position), the table is the shuffled
    corpus.  The order follows from the seed, the rows and how the input is parted.

    Nulls in any column are hashed like values; rows equal in all columns stay separate rows and spread
    over all shards; a text of any length counts as one row (its shard may exceed ``bucket_bytes``); an
    empty table gives no rows; a column already named ``shard`` or ``position`` is kept and the new
    one gets a suffix (``shard_1``).
    """
    rows, size = total_bytes(docs)
    buckets = max(1, math.ceil(size / bucket_bytes))
    shard, position, order_key = fresh(docs.columns, "shard", "position", "order_key")
    inner = T.StructType([*docs.schema.fields, T.StructField(order_key, T.LongType()), T.StructField(shard, T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(position, T.LongType())])
    width = len(docs.columns)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            own = salted(batch.column(width).to_numpy(), seen, part)
            to = (mixed(own + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(own.view(np.int64)), pa.array(to)], names=inner.names)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        bucket = table[shard][0].as_py()
        table = shuffled_bucket(table, seed, bucket, order_key).drop_columns([order_key])
        table = table.append_column(position, pa.array(np.arange(table.num_rows, dtype=np.int64)))
        yield from table.to_batches(max_chunksize=slice_rows)

    keyed = docs.select(*[quoted(c) for c in docs.columns], F.xxhash64(F.lit(seed), *hashable(docs)).alias(order_key))
    return keyed.mapInArrow(scatter, inner).repartitionById(buckets, quoted(shard)).mapInArrow(permute, schema)


def write_shards(docs: DataFrame, path: str, seed: int = 17, bucket_bytes: int = 48 << 20) -> None:
    """Write :func:`external_shuffle` of ``docs`` as one Parquet file a shard (``shard=0/...``), its rows in order."""
    out = external_shuffle(docs, seed, bucket_bytes)
    shard, position = out.columns[-2:]
    out.drop(position).write.partitionBy(shard).parquet(path)
