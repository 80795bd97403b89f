"""Recordings as DataFrames, and what is done with whole files: convert, merge, inspect."""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property
from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.ids import u64
from tracewell.operators import sets, spans, views, wide
from tracewell.sources import wire
from tracewell.sources.dump_source import Headers, read_headers, read_records, write_rings
from tracewell.sources.footers import copy_bytes, copy_with_keys
from tracewell.sources.schema import Registry

#: The order-preserving identity of records while their ids are still bits.
_BITS = ("ts_key", "instance_key", "shard_id", "phys_offset")


@dataclass
class Recording:
    """One or more dumps.  Headers are read at once; records stay in the files until something asks for them."""

    spark: SparkSession
    paths: list[str]

    @cached_property
    def headers(self) -> list[Headers]:
        return [read_headers(p) for p in self.paths]

    @cached_property
    def registry(self) -> Registry:
        return Registry.of(*(h.types for h in self.headers))

    @cached_property
    def views(self) -> list[str]:
        """Registered SQL of all dumps, each text once, as first seen."""
        return list(dict.fromkeys(v for h in self.headers for v in h.views))

    @cached_property
    def hosts(self) -> dict[int, str]:
        """Instances that have a host entry or a ring, ascending in each file; the last host of a file counts, then the first file's."""
        out: dict[int, str] = {}
        for h in self.headers:
            own = dict(h.metas)
            found = sorted({*own, *(s.instance_id for _, s in h.shards)}) or [0]
            for i in found:
                out.setdefault(i, own.get(i, ""))
        return out

    def instances(self) -> DataFrame:
        rows = [(i, host) for i, host in self.hosts.items()]
        return self.spark.createDataFrame([(str(i), h) for i, h in rows], "i string, host string").select(F.col("i").cast("decimal(20,0)").alias("instance_id"), "host")

    def interns(self) -> DataFrame:
        """(instance_id, id, text): of one dump the last entry of an id, of several the first dump's."""
        rows: dict[tuple[int, int], str] = {}
        for h in self.headers:
            own = {(i, k): b.decode("utf-8", "replace") for i, entries in h.interns for k, b in entries}
            for key, text in own.items():
                rows.setdefault(key, text)
        table = self.spark.createDataFrame([(str(i), k, t) for (i, k), t in rows.items()], "i string, id long, text string")
        return table.select(F.col("i").cast("decimal(20,0)").alias("instance_id"), "id", "text")

    def raw(self, types: list[int] | None = None) -> DataFrame:
        """All records of all rings, undecoded, with ids as bits."""
        flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        return read_records(self.spark, self.paths, types).withColumn("ts_key", flip("ts_bits")).withColumn("instance_key", flip("instance_bits"))

    def unique_raw(self, types: list[int] | None = None) -> DataFrame:
        """One record of each identity, that of the first file and ring; compared by integers only.

        Within a ring no two records have one offset, so nothing is compared where every ring is there once.
        """
        rings, raw = [(s.instance_id, s.shard_id) for h in self.headers for _, s in h.shards], self.raw(types)
        return raw if len(set(rings)) == len(rings) else sets.unique(raw, ("file_idx", "section_idx"), _BITS)

    def records(self, types: list[int] | None = None, dedup: bool = True) -> DataFrame:
        """(ts_nanos, event_id, instance_id, shard_id, phys_offset, fields), ids as unsigned decimals."""
        rows = self.unique_raw(types) if dedup else self.raw(types)
        shown = lambda c: wide.unsigned_bits(F.col(c))
        return rows.select(
            shown("ts_bits").alias("ts_nanos"), shown("type_bits").alias("event_id"), shown("instance_bits").alias("instance_id"), "shard_id", "phys_offset", "fields", "file_idx", "section_idx"
        )

    def events(self) -> DataFrame:
        """The sparse-wide table, numbered in merged order."""
        numbered = sets.numbered(self.records())
        return wide.sparse_wide(numbered, self.registry, self.interns() if wide.interned_fields(wide.Plan(self.registry).types) else None)

    def register(self) -> list[str]:
        return views.register(self.events(), self.registry)

    def span_records(self) -> DataFrame:
        """Records with name, phase, span_id and args (JSON of all fields, keys in order, no sentinels applied)."""
        plan = wide.Plan(self.registry)
        rows, texts = self.records(), {}
        if wide.interned_fields(plan.types):
            rows, texts = wide.with_texts(rows, plan.types, self.interns())
        kind = F.col("event_id")
        name = phase = F.lit(None).cast("string")
        span, args = F.lit(None).cast("decimal(20,0)"), F.lit(None).cast("string")
        for t in reversed(plan.types):
            on = kind == u64(t.id)
            name, phase = F.when(on, F.lit(t.name)).otherwise(name), F.when(on, F.lit(t.phase)).otherwise(phase)
            first = next((f for f in t.fields if f.role == "span_id"), None)
            if first is not None:
                span = F.when(on, wide.decoded(first, F.col("fields"), sentinels=False)).otherwise(span)
            values = [wide.decoded(f, F.col("fields"), False, texts.get((t.id, f.name))).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]
            text = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if values else F.lit("{}")
            args = F.when(on, text).otherwise(args)
        return rows.select("instance_id", "shard_id", "ts_nanos", "phys_offset", name.alias("name"), phase.alias("phase"), span.alias("span_id"), args.alias("args"))

    def trace(self) -> DataFrame:
        # copies don't change the last time, so they needn't be dropped for it
        last = self.raw().agg(F.max("ts_key").alias("k")).select(wide.unsigned_bits(F.col("k").bitwiseXOR(F.lit(-(1 << 63)))).alias("ts_nanos"))
        return spans.trace_events(self.span_records(), last)


def load(spark: SparkSession, *paths: str) -> Recording:
    return Recording(spark, list(paths))


# ---- convert


def output_format(out: str | None, given: str | None) -> str:
    if given in ("parquet", "trace"):
        return given
    ending = Path(out or "").suffix.lower()
    found = {".parquet": "parquet", ".json": "trace"}.get(ending)
    if found is None:
        raise ValueError("say --format parquet or trace, or give an output that ends in .parquet or .json")
    return found


def convert(spark: SparkSession, paths: list[str], out: str | None = None, format: str | None = None, host: str | None = None, level: int = 3) -> str:
    """Dumps as one table or one trace; returns where it is.

    A table is a folder of Parquet files in merged order, each with the format, host and views in its
    footer, and a ``.views.sql`` beside it.  A trace is one JSON file with a line for each event.
    """
    kind = output_format(out, format)
    out = out or str(Path(paths[0]).with_suffix(".parquet" if kind == "parquet" else ".json"))
    recording = load(spark, *paths)
    if kind == "trace":
        if host is not None:
            raise ValueError("a trace has no host")
        write_trace(recording, out)
        return out
    if not 1 <= level <= 22:
        raise ValueError("the level of compression is from 1 to 22")
    text = views.ddl(recording.registry, recording.views)
    name = host if host is not None else next((h for h in recording.hosts.values() if h), "")
    footer = {f"{wire.PREFIX}.format": "1", f"{wire.PREFIX}.host": name, f"{wire.PREFIX}.views": text}
    write_table(recording.events(), out, {k: v for k, v in footer.items() if v}, level)
    Path(f"{out}.views.sql").write_text(views.ddl(recording.registry, recording.views, bind=f"{Path(out).name}/*.parquet"))
    return out


def write_table(events: DataFrame, out: str, footer: dict[str, str], level: int = 3) -> None:
    """Parquet in the order of ``seq``, with extra keys in each file's footer, which Spark's own writer can't add.

    Spark writes the rows (row groups by size, zstd); files are then copied, task by task, each with a new footer:
    no row is decoded for that.
    """
    spark = events.sparkSession
    draft = f"{out}.draft-{uuid.uuid4().hex}"
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)}
    events.sort("seq").write.options(**options).parquet(draft)
    os.makedirs(out, exist_ok=True)
    files = sorted(glob.glob(f"{draft}/part-*.parquet"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                copy_with_keys(path, f"{out}/{Path(path).name}", footer)
            yield frame

    spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInPandas(add, "path string").foreach(lambda r: None)
    shutil.rmtree(draft)


def footer_of(path: str) -> dict[str, str]:
    """The extra keys of a table's (or file's) footer."""
    file = path if os.path.isfile(path) else sorted(glob.glob(f"{path}/*.parquet"))[0]
    meta = pq.read_metadata(file).metadata or {}
    return {k.decode(): v.decode() for k, v in meta.items() if k.decode().startswith(f"{wire.PREFIX}.")}


_TRACE_START, _TRACE_END = '{"displayTimeUnit":"ns","traceEvents":[', "]}"


def write_trace(recording: Recording, out: str) -> int:
    """One trace file; its events, in order of time, are written in parts and put together.  Returns their number.

    Each event has a line of its own, so that :func:`read_trace` can take the file in pieces.  Parts are joined as
    bytes: tasks write the commas.
    """
    parts = f"{out}.parts-{uuid.uuid4().hex}"
    # sorted before it is text: Spark makes the rows to be sorted twice, as it looks for the bounds of parts first
    rows = spans.trace_json(recording.trace().orderBy("ts_nanos", "pid", "tid"))
    rows.select("value").write.option("lineSep", ",\n").text(parts)
    n = 0
    with open(out, "wb") as f:
        f.write(f"{_TRACE_START}\n".encode())
        for part in sorted(glob.glob(f"{parts}/part-*")):
            with open(part, "rb") as lines:
                while piece := lines.read(1 << 22):
                    f.write(piece)
                    n += piece.count(b"\n")
        if n:  # the last event has no comma
            f.seek(-2, os.SEEK_CUR)
            f.write(b"\n")
        f.write(_TRACE_END.encode())
    shutil.rmtree(parts)
    return n


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a file of :func:`write_trace`, typed by ``schema`` (that of one event): lines, read by many tasks.

    As one JSON document the file would be one row, which one task parses whole.
    """
    lines = spark.read.text(path, lineSep="\n").where(~F.col("value").isin(_TRACE_START, _TRACE_END))
    return lines.select(F.from_json(F.rtrim("value", F.lit(",")), schema, {"mode": "FAILFAST"}).alias("t")).select("t.*")


# ---- merge


def _sections(recording: Recording) -> list[tuple[int, bytes]]:
    first = [(wire.SCHEMA, wire.types_body(recording.registry.types.values()))]
    return first + [(wire.VIEWS, v.encode()) for v in recording.views]


def merge(spark: SparkSession, paths: list[str], out: str, dedup: bool = True) -> str:
    """Several dumps as one: each record once and rings no larger than they must be, or all sections as they are."""
    if len(paths) < 2:
        raise ValueError("merging takes two dumps or more")
    recording = load(spark, *paths)
    before = _sections(recording)
    if not dedup:
        splice(recording, out)
        return out
    first_host: dict[int, str] = {}
    entries: dict[int, dict[int, bytes]] = {}
    for h in recording.headers:
        for i, host in h.metas:
            first_host.setdefault(i, host)
        for i, table in h.interns:
            for k, text in table:
                entries.setdefault(i, {}).setdefault(k, text)
    for i in sorted({*first_host, *entries}):
        before.append((wire.META, wire.meta_body(i, first_host.get(i, ""))))
        if i in entries:
            before.append((wire.INTERN, wire.intern_body(i, entries[i].items())))

    write_rings(recording.unique_raw(), ["ts_key", "phys_offset"], out, before)
    return out


def splice(recording: Recording, out: str) -> None:
    """All sections of all dumps but schemas and views, which are united; bytes are copied as they are."""
    sections = _sections(recording)
    copied = [(p, s) for p, h in zip(recording.paths, recording.headers) for s in h.sections if s.kind in (wire.INTERN, wire.SHARD, wire.META)]
    with open(out, "wb") as f:
        f.write(wire.layout([(k, len(b)) for k, b in sections] + [(s.kind, s.length) for _, s in copied]))
        for _, body in sections:
            f.write(body)
        for path, s in copied:
            with open(path, "rb") as source:
                source.seek(s.offset)
                copy_bytes(source, f, s.length)


def write_dump(records: DataFrame, registry: Registry, interns: dict[int, list[tuple[int, bytes]]], hosts: dict[int, str], out: str, registered: list[str] = ()) -> None:
    """A dump of records (ts_nanos, event_id, instance_id, shard_id, fields and an ``arrival`` order)."""
    before = [(wire.SCHEMA, wire.types_body(registry.types.values()))]
    before += [(wire.INTERN, wire.intern_body(i, e)) for i, e in interns.items()]
    before += [(wire.VIEWS, v.encode()) for v in registered] + [(wire.META, wire.meta_body(i, h)) for i, h in hosts.items()]
    signed = lambda c: F.when(F.col(c) >= F.lit(Decimal(1 << 63)), F.col(c) - F.lit(Decimal(1 << 64))).otherwise(F.col(c)).cast("bigint")

    rows = records.select(
        signed("ts_nanos").alias("ts_bits"), signed("event_id").alias("type_bits"), signed("instance_id").alias("instance_bits"), F.col("shard_id").cast("long").alias("shard_id"), "fields", "arrival"
    )
    write_rings(rows, ["arrival", "ts_bits", "type_bits", "fields"], out, before)


# ---- inspect


def counts(recording: Recording) -> tuple[DataFrame, DataFrame]:
    """Records by event name (versions together, nothing dropped) and by ring."""
    rows = recording.raw()
    name: Column = F.lit(None).cast("string")
    for t in recording.registry.types.values():
        name = F.when(wide.unsigned_bits(F.col("type_bits")) == u64(t.id), F.lit(t.name)).otherwise(name)
    by_name = rows.groupBy(name.alias("event")).agg(F.count(F.lit(1)).alias("records"))
    by_ring = rows.groupBy("file_idx", "section_idx").agg(F.count(F.lit(1)).alias("records"))
    return by_name, by_ring


def inspect(spark: SparkSession, path: str) -> str:
    """A summary of one dump as text."""
    recording = load(spark, path)
    h = recording.headers[0]
    by_name, by_ring = counts(recording)
    rings = {r.section_idx: r.records for r in by_ring.toLocalIterator()}
    out = [f"dump of {h.size} bytes, flags {h.flags:#06x}, {len(h.sections)} sections", f"\nevent types: {len(h.types)}"]
    marks = {"key": "*", "span_id": "$", "parent_span_id": "^"}
    for t in h.types:
        phase = f" [{t.phase}]" if t.phase != "none" else ""
        out.append(f"  {t.id:#018x} {t.name} ({t.record_size} bytes, {len(t.fields)} fields){phase}" + (f": {t.description}" if t.description else ""))
        for f in t.fields:
            out.append(f"    {marks.get(f.role, ' ')}{f.name}: {f.kind}" + (f" [{f.unit}]" if f.unit else "") + (f" absent at {f.sentinel}" if f.sentinel is not None else ""))
    out.append(f"\ninstances: {len(h.metas)}")
    for i, host in h.metas:
        n = sum(len(e) for k, e in h.interns if k == i)
        out.append(f"  {i:#018x} {host or '(no host)'}, {n} interned texts")
    out.append(f"\ninterned texts: {sum(len(e) for _, e in h.interns)} of {len(h.interns)} instances")
    if h.views:
        out.append(f"\nregistered statements: {len(h.views)} sets, {sum(len(v.splitlines()) for v in h.views)} lines")
        out += [f"  {i}: {len(v.encode())} bytes, {len(v.splitlines())} lines" for i, v in enumerate(h.views, 1)]
    out.append(f"\nrings: {len(h.shards)}")
    for idx, s in h.shards:
        out.append(f"  instance {s.instance_id:#018x} shard {s.shard_id}: head {s.head}, capacity {s.capacity}, {rings.get(idx, 0)} records")
    out.append(f"\nrecords: {sum(rings.values())}")
    out += [f"  {r.event}: {r.records}" for r in by_name.orderBy("event").toLocalIterator()]
    return "\n".join(out) + "\n"


GUIDE = """Convert dumps with `python -m tracewell convert a.dump -o out.parquet`, then read the table in SQL:
`events` has seq, ts_nanos, event, event_id, instance_id, the key columns, and a struct for each event type.
Views named after event types hold their rows; the manifest view lists the keys that events share.  Order by
(ts_nanos, instance_id, seq).  A field's absent value is NULL.  Registered statements in a dump are text: read
them before you run them.
"""


def default_threads(cpus: int) -> int:
    """Tasks at once for a conversion beside other work: a quarter of the CPUs, 1 to 4."""
    return max(1, min(4, cpus // 4))


def describe(recording: Recording) -> str:
    """The registry as JSON, for tools."""
    return json.dumps([{"id": str(t.id), "name": t.name, "phase": t.phase, "size": t.record_size, "fields": [f.name for f in t.fields]} for t in recording.registry.sorted()])
