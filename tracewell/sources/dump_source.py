"""Dumps as Spark data sources: one partition a ring to read, one part file a partition to write."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracewell.functions.ids import next_pow2
from tracewell.sources import wire
from tracewell.sources.footers import copy_bytes
from tracewell.sources.ring import packed, walk_pieces
from tracewell.sources.schema import EventType

#: Ids and times as the bits of unsigned numbers; operators turn them into decimals where they are shown.
RAW = "file_idx int, section_idx int, instance_bits long, shard_id long, phys_offset long, ts_bits long, type_bits long, fields binary"
BATCH = 65_536


def open_input(path: str):
    """A seekable file of the local or any other file system that Arrow knows by its address."""
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return open(path, "rb")


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


@dataclass
class Headers:
    """What a dump says besides its records, read without its rings."""

    flags: int
    size: int
    sections: list[wire.Section]
    types: list[EventType]
    interns: list[tuple[int, list[tuple[int, bytes]]]]
    metas: list[tuple[int, str]]
    views: list[str]
    shards: list[tuple[int, wire.ShardHeader]]  # with the section's number


def read_headers(path: str) -> Headers:
    with open_input(path) as f:
        f.seek(0, 2)
        size = f.tell()
        start = read_at(f, 0, 16)
        flags, sections = wire.envelope(read_at(f, 0, wire.table_bytes(start)), size)
        body = lambda s, n=None: read_at(f, s.offset, s.length if n is None else min(n, s.length))
        schemas = [s for s in sections if s.kind == wire.SCHEMA]
        try:
            views = [body(s).decode() for s in sections if s.kind == wire.VIEWS]
        except UnicodeDecodeError as e:
            raise wire.DumpError("InvalidUtf8") from e
        return Headers(
            flags,
            size,
            sections,
            wire.read_types(body(schemas[0])) if schemas else [],
            [wire.read_interns(body(s)) for s in sections if s.kind == wire.INTERN],
            [wire.read_meta(body(s)) for s in sections if s.kind == wire.META],
            views,
            [(i, wire.read_shard_header(body(s, wire.SHARD_HEADER), s)) for i, s in enumerate(sections) if s.kind == wire.SHARD],
        )


@dataclass
class ShardPartition(InputPartition):
    path: str
    file_idx: int
    section_idx: int
    header: wire.ShardHeader
    sizes: dict[int, int]
    wanted: frozenset[int] | None


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class DumpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        wanted = options.get("types")
        self.wanted = None if wanted is None else frozenset(json.loads(wanted))

    def partitions(self) -> list[ShardPartition]:
        out = []
        for file_idx, path in enumerate(self.paths):
            headers = read_headers(path)
            sizes: dict[int, int] = {}
            for t in headers.types:
                sizes[t.id] = t.record_size
            for section_idx, h in headers.shards:
                if h.capacity > 0xFFFF_FFFF:
                    raise wire.DumpError("TooLarge", f"a shard of {h.capacity} bytes")
                out.append(ShardPartition(path, file_idx, section_idx, h, sizes, self.wanted))
        return out

    def read(self, partition: ShardPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no ring at all
            return
        h = partition.header
        rows: list[tuple[int, int, int, bytes]] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, partition.file_idx, np.int32)),
                    pa.array(np.full(n, partition.section_idx, np.int32)),
                    _signed([h.instance_id] * n),
                    pa.array(np.full(n, h.shard_id, np.int64)),
                    pa.array([r[2] for r in rows], pa.int64()),
                    _signed([r[0] for r in rows]),
                    _signed([r[1] for r in rows]),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=["file_idx", "section_idx", "instance_bits", "shard_id", "phys_offset", "ts_bits", "type_bits", "fields"],
            )

        with open_input(partition.path) as f:
            for record in walk_pieces(lambda begin, n: read_at(f, h.offset + begin, n), h.head, h.capacity, partition.sizes):
                if partition.wanted is None or record[1] in partition.wanted:
                    rows.append(record)
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    path: str
    pieces: list[tuple[int, int, int, int, int]]  # instance, shard, place among the ring's pieces, start in the file, bytes


class DumpWriter(DataSourceArrowWriter):
    """Writes records, ring by ring and in order, as pieces of rings; the driver puts the envelope and rings together.

    A task holds one batch at a time and a ring may lie across tasks, so no task's memory grows with a ring.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.out = options["out"]
        self.before = [(k, bytes.fromhex(b)) for k, b in json.loads(options.get("before", "[]"))]
        self.folder = f"{self.out}.parts-{options.get('token', uuid.uuid4().hex)}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        path, pieces = f"{self.folder}/{uuid.uuid4().hex}", []
        with open(path, "wb") as f:
            for batch in iterator:
                instance, shard, place, ts, kind = (batch.column(c).to_numpy() for c in ("instance_bits", "shard_id", "place", "ts_bits", "type_bits"))
                cuts = np.flatnonzero((instance[1:] != instance[:-1]) | (shard[1:] != shard[:-1])) + 1
                for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                    if a == b:  # a batch without rows
                        continue
                    ring, at = (int(instance[a]) & ((1 << 64) - 1), int(shard[a])), f.tell()
                    n = f.write(packed(ts[a:b], kind[a:b], batch.column("fields").slice(a, b - a)))
                    if pieces and pieces[-1][:2] == ring:
                        pieces[-1] = (*pieces[-1][:4], pieces[-1][4] + n)
                    else:
                        pieces.append((*ring, int(place[a]), at, n))
        return Part(path, pieces)

    def commit(self, messages: list[Part | None]) -> None:
        rings: dict[tuple[int, int], list[tuple[int, str, int, int]]] = {}
        for m in messages:
            for instance, shard, *piece in m.pieces if m else ():
                rings.setdefault((instance, shard), []).append((piece[0], m.path, *piece[1:]))
        heads = {ring: sum(n for *_, n in pieces) for ring, pieces in sorted(rings.items())}
        with open(f"{self.folder}.tmp", "wb") as out:
            out.write(wire.layout([(k, len(b)) for k, b in self.before] + [(wire.SHARD, wire.SHARD_HEADER + next_pow2(n)) for n in heads.values()]))
            for _, body in self.before:
                out.write(body)
            for ring, head in heads.items():
                out.write(wire.shard_header(*ring, head, next_pow2(head)))
                for _, path, at, n in sorted(rings[ring]):
                    with open(path, "rb") as f:
                        f.seek(at)
                        copy_bytes(f, out, n)
                out.seek(next_pow2(head) - head, os.SEEK_CUR)
            out.truncate()  # zeros to the end of the last ring
        os.replace(f"{self.folder}.tmp", self.out)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class DumpSource(DataSource):
    """``spark.read.format("flightdump")`` with the option ``paths``, a JSON list of files."""

    @classmethod
    def name(cls) -> str:
        return "flightdump"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return DumpReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DumpWriter(self.options)


def read_records(spark: SparkSession, paths: list[str], types: list[int] | None = None) -> DataFrame:
    """The records of all rings of all files, undecoded, as RAW; ``types`` leaves all but those ids out at the source."""
    spark.dataSource.register(DumpSource)
    reader = spark.read.format("flightdump").option("paths", json.dumps(paths))
    return (reader if types is None else reader.option("types", json.dumps(types))).load()


def write_rings(records: DataFrame, order: list[str], out: str, before: list[tuple[int, bytes]]) -> None:
    """A dump of the given sections and one shard for each (instance_bits, shard_id), no larger than it must be.

    ``records`` have ts_bits, type_bits and fields; a ring's stand in the order of the columns ``order``.  They are
    range-partitioned, so that many tasks write a ring.  ``out`` and its part files are in a folder that driver and
    executors share.
    """
    spark = records.sparkSession
    spark.dataSource.register(DumpSource)
    options = {"out": out, "before": json.dumps([(k, b.hex()) for k, b in before]), "token": uuid.uuid4().hex}
    keys = ["instance_bits", "shard_id", *order]
    placed = records.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows = placed.select("instance_bits", "shard_id", F.monotonically_increasing_id().alias("place"), "ts_bits", "type_bits", "fields")
    rows.write.format("flightdump").mode("append").options(**options).save()
