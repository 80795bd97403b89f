"""Registered queries and the SQL that states each of them independently."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import engine
from tracewell.functions import ids
from tracewell.operators import retention, sets, spans, views, wide
from tracewell.plans.stream import SQL, TYPES, event_type, registry, scratch, stream
from tracewell.sources.encode import encoded
from tracewell.sources.schema import Declared, EventType, Registry, event

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_HOUR = 3_600_000_000_000
_RING = 8192


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL over ``s``, the stream, and the plain tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE s AS ({SQL}){sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _tied(s: DataFrame) -> DataFrame:
    return s.withColumn("ts_nanos", F.expr(f"ts_nanos div {_HOUR} * {_HOUR}"))


def _halves(s: DataFrame, rows: int) -> DataFrame:
    """Two overlapping snapshots of the stream."""
    return sets.union_all(s.where(F.col("row_id") < F.lit(rows * 6 // 10)), s.where(F.col("row_id") >= F.lit(rows * 4 // 10)))


_TWO = (
    ", n AS (SELECT count(*) AS n FROM s), u AS (SELECT s.*, 0 AS stream_idx FROM s, n WHERE row_id < n.n * 6 // 10 "
    "UNION ALL SELECT s.*, 1 FROM s, n WHERE row_id >= n.n * 4 // 10) "
)


# ---- set plane


@query("SELECT row_id, ts_nanos, instance_id, shard_id, phys_offset, row_number() OVER (ORDER BY ts_nanos, instance_id, shard_id, phys_offset) - 1 AS seq FROM s")
def merge_order_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All streams in merged order, numbered from 0."""
    return sets.numbered(stream(spark, sf_dir).select("row_id", *sets.IDENTITY))


@query(f"SELECT row_id, ts_nanos // {_HOUR} * {_HOUR} AS ts_nanos, row_number() OVER (ORDER BY ts_nanos // {_HOUR}, instance_id, shard_id, phys_offset) - 1 AS seq FROM s")
def merge_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged order where many records share a time: instance, shard and offset decide."""
    return sets.numbered(_tied(stream(spark, sf_dir)).select("row_id", *sets.IDENTITY)).select("row_id", "ts_nanos", "seq")


@query(_TWO + "SELECT DISTINCT row_id, ts_nanos, instance_id, shard_id, phys_offset, user_id, value_cents FROM u")
def dedup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping snapshots as one, each record once."""
    s = stream(spark, sf_dir)
    return sets.unique(_halves(s, s.count())).select("row_id", *sets.IDENTITY, "user_id", "value_cents")


@query(_TWO + "SELECT row_id, min(stream_idx) AS stream_idx, count(*) AS copies FROM u GROUP BY row_id")
def dedup_survivor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snapshot a record was kept from, and how many had it."""
    s = stream(spark, sf_dir)
    both = _halves(s, s.count())
    kept = sets.unique(both)
    copies = both.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"))
    return kept.select("row_id", "stream_idx").join(copies, "row_id")


@query(_TWO + "SELECT instance_id, count(*) AS raw_records, count(DISTINCT row_id) AS unique_records FROM u GROUP BY instance_id")
def union_all_raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records an instance has before and after identity counts."""
    s = stream(spark, sf_dir)
    # one shuffle: copies of an identity are counted first, then instances add up
    per = _halves(s, s.count()).groupBy(*sets.IDENTITY).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("instance_id").agg(F.sum("n").alias("raw_records"), F.count(F.lit(1)).alias("unique_records"))


@query(
    _TWO + ", k AS (SELECT DISTINCT row_id, ts_nanos, instance_id, shard_id FROM u) SELECT instance_id, shard_id, count(*) AS records, min(ts_nanos) AS first_ts, "
    "max(ts_nanos) AS last_ts, CAST(count(*) * 50 AS BIGINT) AS ring_bytes, CAST(1 AS BIGINT) << length(trim(ltrim(bin(count(*) * 50 - 1), '0'))) AS capacity FROM k GROUP BY ALL"
)
def merge_group_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged dump's rings hold and how large each must be."""
    s = stream(spark, sf_dir)
    return sets.survivors(sets.unique_any(_halves(s, s.count())), F.lit(32).cast("long"))


@query("SELECT row_id, ts_nanos, instance_id, shard_id, phys_offset, row_number() OVER (ORDER BY ts_nanos, instance_id, shard_id, phys_offset) - 1 AS seq FROM s")
def scalable_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers by partition offsets, of a stream laid out at random."""
    return sets.numbered(stream(spark, sf_dir).select("row_id", *sets.IDENTITY).repartition(7, "row_id"))


# ---- wide table and views


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream as a sparse-wide table, its rows being decoded already."""
    plan = wide.Plan(registry())
    s = stream(spark, sf_dir)
    kind = F.lit(None).cast(ids.U64)
    for t in plan.types:
        kind = F.when(F.col("event") == t.name, ids.u64(t.id)).otherwise(kind)
    s = s.withColumn("type_id", kind)
    value = lambda t, f: F.lit("00000000") if f.kind == "bytes" else F.col(f.name).cast(wide._TYPES[f.output])
    return s.select(
        "ts_nanos", plan.event_name(F.col("type_id")).alias("event"), F.col("type_id").alias("event_id"), "instance_id", "shard_id", "phys_offset",
        *plan.promoted_columns(F.col("type_id"), value), *plan.struct_columns(F.col("type_id"), value),
    )


_STRUCTS = ", ".join(f"CASE WHEN event_type = '{t}' THEN value_cents END AS {t}_cents, CASE WHEN event_type = '{t}' THEN props END AS {t}_props" for t in TYPES)


@query(f"SELECT ts_nanos, event, instance_id, row_id, user_id, {_STRUCTS} FROM s")
def sparse_wide_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with its structs laid flat: null where a row is of another event."""
    w = _wide(spark, sf_dir)
    flat = [F.col(f"`app::{t}`.{f}").alias(f"{t}_{a}") for t in TYPES for f, a in (("value_cents", "cents"), ("props", "props"))]
    return w.select("ts_nanos", "event", "instance_id", F.col("row_id").cast("bigint").alias("row_id"), F.col("user_id").cast("bigint").alias("user_id"), *flat)


@query("SELECT row_id, ts_nanos, value_cents FROM s WHERE event_type = 'purchase'")
def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of one event type, by its id."""
    v = views.event_view(_wide(spark, sf_dir), event_type("purchase").id)
    return v.select(F.col("row_id").cast("bigint").alias("row_id"), "ts_nanos", F.col("`app::purchase`.value_cents").alias("value_cents"))


@query("SELECT DISTINCT event, f.field, 'key' AS role FROM s, (VALUES ('row_id'), ('user_id')) AS f(field)")
def key_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns events share."""
    return views.manifest(spark, registry())


@query("SELECT CAST(NULL AS VARCHAR) AS event, '' AS field, '' AS role FROM s WHERE 1 = 0")
def key_manifest_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a registry without keys."""
    return views.manifest(spark, Registry.of([event("app::plain", Declared("n", "u32"))]))


@query("SELECT event, count(*) AS records FROM s GROUP BY event")
def count_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "event")


@query("SELECT instance_id, event, count(*) AS records FROM s GROUP BY ALL")
def count_by_instance_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).groupBy("instance_id", "event").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT ts_nanos, event, row_id, user_id, instance_id FROM s WHERE user_id = 7")
def key_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events about one key, whatever their type, in order of time."""
    w = _wide(spark, sf_dir).where(F.col("user_id") == 7)
    return w.select("ts_nanos", "event", F.col("row_id").cast("bigint").alias("row_id"), F.col("user_id").cast("bigint").alias("user_id"), "instance_id").orderBy("ts_nanos", "instance_id", "row_id")


@query("SELECT row_id, event, value_cents FROM s WHERE user_id = 11 AND value_cents >= 10000")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered query with arguments, as a table function."""
    stream(spark, sf_dir).createOrReplaceTempView("recorded_stream")
    views.table_function(spark, "spending", "who BIGINT, least BIGINT", "SELECT row_id, event, value_cents FROM recorded_stream WHERE user_id = who AND value_cents >= least")
    return spark.sql("SELECT * FROM spending(11L, 10000L)")


@query("SELECT a.user_id, count(*) AS pairs, min(b.ts_nanos - a.ts_nanos) AS least_gap FROM s a JOIN s b ON a.user_id = b.user_id WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY a.user_id")
def cross_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event views joined on a key that the manifest lists."""
    s = stream(spark, sf_dir)
    a = s.where("event_type = 'signup'").select("user_id", F.col("ts_nanos").alias("a_ts"))
    b = s.where("event_type = 'purchase'").select("user_id", F.col("ts_nanos").alias("b_ts"))
    return a.join(b, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.col("b_ts") - F.col("a_ts")).alias("least_gap"))


@query("SELECT instance_id, 'host-' || instance_id AS host, count(*) AS records FROM s WHERE instance_id < 2 GROUP BY instance_id UNION ALL SELECT instance_id, NULL, count(*) FROM s WHERE instance_id >= 2 GROUP BY instance_id")
def instance_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with their hosts; one has none."""
    hosts = spark.createDataFrame([(0, "host-0"), (1, "host-1")], "instance_id long, host string")
    n = stream(spark, sf_dir).groupBy("instance_id").agg(F.count(F.lit(1)).alias("records"))
    return n.join(hosts, "instance_id", "left").select("instance_id", "host", "records")


# ---- field decoding on records built from the stream


def _recorded(spark: SparkSession, sf_dir: str, t: EventType, **columns) -> DataFrame:
    """Rows of the stream as records of type ``t`` (``row_id``, ``fields``), fields from the given columns."""
    rows = stream(spark, sf_dir).select("row_id", "instance_id", *[c.alias(n) for n, c in columns.items()])
    return encoded(rows, t).select("row_id", "instance_id", "fields")


@query("SELECT row_id, CASE CAST(row_id % 4 AS INTEGER) WHEN 0 THEN 'Idle' WHEN 1 THEN 'Busy' WHEN 2 THEN 'Done' ELSE CAST(row_id % 4 AS VARCHAR) END AS state FROM s")
def enum_label_and_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of an enum, a value without one as its number."""
    t = event("app::state", Declared("state", "enum", labels=((0, "Idle"), (1, "Busy"), (2, "Done"))))
    rows = _recorded(spark, sf_dir, t, state=F.col("row_id") % 4)
    return rows.select("row_id", wide.decoded(t.fields[0], F.col("fields")).alias("state"))


@query("SELECT row_id, CASE WHEN user_id % 5 = 0 THEN '#' || user_id ELSE 'user ' || user_id || ' of ' || instance_id END AS name FROM s")
def intern_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interned texts by instance and id; ids without a text are shown as numbers."""
    t = event("app::name", Declared("name", "interned"))
    rows = _recorded(spark, sf_dir, t, name=F.col("user_id")).withColumn("event_id", ids.u64(t.id))
    known = stream(spark, sf_dir).select("instance_id", F.col("user_id").alias("id")).distinct().where("id % 5 <> 0")
    known = known.withColumn("text", F.concat(F.lit("user "), F.col("id"), F.lit(" of "), F.col("instance_id")))
    joined, texts = wide.with_texts(rows, [t], known)
    return joined.select("row_id", wide.decoded(t.fields[0], F.col("fields"), text_of=texts[t.id, "name"]).alias("name"))


@query("SELECT row_id, nullif(row_id % 3, 0) AS code, nullif(CAST(row_id % 5 AS BIGINT) - 1, -1) AS delta, row_id % 3 = 0 AS code_is_null FROM s")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent values of unsigned and signed fields as nulls."""
    t = event("app::gap", Declared("code", "u32", sentinel=0), Declared("delta", "i32", sentinel=-1))
    rows = _recorded(spark, sf_dir, t, code=F.col("row_id") % 3, delta=F.col("row_id") % 5 - 1)
    code, delta = (wide.decoded(f, F.col("fields")) for f in t.fields)
    return rows.select("row_id", code.cast("bigint").alias("code"), delta.alias("delta"), code.isNull().alias("code_is_null"))


@query(
    "SELECT row_id, row_id % 256 AS a, row_id * 7 % 65536 AS b, CAST(CASE WHEN (row_id % 256) >= 128 THEN (row_id % 256) - 256 ELSE row_id % 256 END AS BIGINT) AS c, "
    "-value_cents AS d, user_id % 2 = 1 AS e FROM s"
)
def field_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian numbers of several widths, signed and not, and truth values."""
    t = event("app::mix", Declared("a", "u8"), Declared("b", "u16"), Declared("c", "i8"), Declared("d", "i64"), Declared("e", "bool"))
    rows = _recorded(spark, sf_dir, t, a=F.col("row_id"), b=F.col("row_id") * 7, c=F.col("row_id"), d=-F.col("value_cents"), e=F.col("user_id") % 2)
    a, b, c, d, e = (wide.decoded(f, F.col("fields")) for f in t.fields)
    return rows.select("row_id", a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.alias("c"), d.alias("d"), e.alias("e"))


@query("SELECT row_id, lower(hex(props::BLOB)) AS props_hex, '0x' || lpad(lower(printf('%X', user_id)), 16, '0') AS user_hex, split_part(event, '::', 1) AS cat, CAST(ts_nanos AS DOUBLE) / 1000 AS ts_us FROM s")
def hex_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and ids as hexadecimal text, categories and microseconds."""
    s = stream(spark, sf_dir)
    return s.select("row_id", ids.bytes_text(F.col("props").cast("binary")).alias("props_hex"), ids.id_text(F.col("user_id")).alias("user_hex"), ids.category(F.col("event")).alias("cat"), ids.micros(F.col("ts_nanos")).alias("ts_us"))


@query("SELECT row_id, strftime(make_timestamp(ts_nanos // 1000), '%Y%m%dT%H%M%S%gZ') AS stamp FROM s")
def utc_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of dump files, in UTC whatever the session's zone is."""
    return stream(spark, sf_dir).select("row_id", ids.stamp(F.expr("ts_nanos div 1000000")).alias("stamp"))


@query(
    "SELECT row_id, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(event, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS id FROM s"
)
def fnv_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of the events' names, as columns."""
    return stream(spark, sf_dir).select("row_id", ids.fnv1a64_of(F.col("event").cast("binary")).cast("string").alias("id"))


def _versions() -> tuple[EventType, EventType]:
    return event("app::evt", Declared("a", "u64", role="key")), event("app::evt", Declared("a", "u64", role="key"), Declared("b", "u32"))


@query(
    "SELECT CASE WHEN row_id % 2 = 0 THEN '" + f"app::evt#{_versions()[0].id:016x}" + "' ELSE '" + f"app::evt#{_versions()[1].id:016x}" + "' END AS event, count(*) AS records, sum(CASE WHEN row_id % 2 = 1 THEN user_id END)::BIGINT AS b_sum FROM s GROUP BY ALL"
)
def registry_union_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of one name from two registries: each its own event, told apart by id."""
    one, two = _versions()
    reg = Registry.of([one], [two, one])
    s = stream(spark, sf_dir)
    parts = []
    for k, t in enumerate((one, two)):
        rows = s.where(F.col("row_id") % 2 == k).select("row_id", "ts_nanos", "instance_id", F.col("row_id").alias("a"), F.col("user_id").alias("b"))
        parts.append(encoded(rows, t).select(F.col("row_id").alias("seq"), "ts_nanos", ids.u64(t.id).alias("event_id"), "instance_id", "fields"))
    w = wide.sparse_wide(parts[0].unionByName(parts[1]), reg)
    plan = wide.Plan(reg)
    return w.groupBy("event").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col(f"`{plan.structs[two.id]}`.b")).cast("bigint").alias("b_sum"))


@query("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN user_id END AS who, event FROM (SELECT row_id, user_id, CASE WHEN row_id % 2 = 0 THEN 'app::a' ELSE 'app::b' END AS event FROM s)")
def type_drift_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key declared with two kinds: the first declaration's column, null for the other."""
    a, b = event("app::a", Declared("who", "u64", role="key")), event("app::b", Declared("who", "i64", role="key"))
    s = stream(spark, sf_dir)
    parts = []
    for k, t in enumerate((a, b)):
        rows = s.where(F.col("row_id") % 2 == k).select("row_id", "ts_nanos", "instance_id", F.col("user_id").alias("who"))
        parts.append(encoded(rows, t).select(F.col("row_id").alias("seq"), "ts_nanos", ids.u64(t.id).alias("event_id"), "instance_id", "fields"))
    w = wide.sparse_wide(parts[0].unionByName(parts[1]), Registry.of([a, b]))
    return w.select(F.col("seq").alias("row_id"), F.col("who").cast("bigint").alias("who"), "event")


@query("SELECT row_id, user_id, value_cents FROM s WHERE event_type = 'click'")
def star_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but some, and fields inside an event's struct."""
    _wide(spark, sf_dir).createOrReplaceTempView("recorded_wide")
    others = ", ".join(f"`app::{t}`" for t in TYPES if t != "click")
    rows = spark.sql(f"SELECT * EXCEPT (ts_nanos, event, event_id, instance_id, shard_id, phys_offset, {others}) FROM recorded_wide WHERE `app::click` IS NOT NULL")
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("user_id").cast("bigint").alias("user_id"), F.col("`app::click`.value_cents").alias("value_cents"))


# ---- spans


def _span_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = stream(spark, sf_dir)
    enters = s.where("row_id % 7 <> 0").select("instance_id", "shard_id", F.col("row_id").alias("span_id"), "ts_nanos", F.lit("enter").alias("phase"), F.concat("event", F.lit("Start")).alias("name"))
    exits = s.where("row_id % 10 <> 0").select("instance_id", "shard_id", F.col("row_id").alias("span_id"), (F.col("ts_nanos") + F.col("value_cents") * 1000).alias("ts_nanos"), F.lit("exit").alias("phase"), F.concat("event", F.lit("End")).alias("name"))
    return enters, exits


_SPANS = (
    ", en AS (SELECT instance_id, shard_id, row_id AS span_id, ts_nanos, event || 'Start' AS name FROM s WHERE row_id % 7 <> 0)"
    ", ex AS (SELECT instance_id, shard_id, row_id AS span_id, ts_nanos + value_cents * 1000 AS ts_nanos, event || 'End' AS name FROM s WHERE row_id % 10 <> 0) "
)


@query(_SPANS + "SELECT instance_id, span_id, en.ts_nanos AS enter_ts, ex.ts_nanos AS exit_ts, ex.ts_nanos - en.ts_nanos AS duration_ns FROM en JOIN ex USING (instance_id, span_id)")
def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pairs(*_span_records(spark, sf_dir))


@query(_SPANS + "SELECT instance_id, span_id, ts_nanos, 'enter' AS phase FROM en ANTI JOIN ex USING (instance_id, span_id) UNION ALL SELECT instance_id, span_id, ts_nanos, 'exit' FROM ex ANTI JOIN en USING (instance_id, span_id)")
def span_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of spans whose other half was overwritten."""
    enters, exits = _span_records(spark, sf_dir)
    cols = ["instance_id", "span_id", "ts_nanos", "phase"]
    return spans.orphan_enters(enters, exits).select(cols).unionAll(spans.orphan_exits(enters, exits).select(cols))


@query(_SPANS + "SELECT instance_id, count(*) AS records FROM (SELECT * FROM en SEMI JOIN ex USING (instance_id, span_id) UNION ALL SELECT * FROM ex SEMI JOIN en USING (instance_id, span_id)) GROUP BY instance_id")
def span_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of spans that have both halves."""
    enters, exits = _span_records(spark, sf_dir)
    both = spans.paired(enters, exits).unionByName(spans.paired(exits, enters))
    return both.groupBy("instance_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    _SPANS + "SELECT instance_id, span_id, min(en.ts_nanos) AS enter_ts, min(ex.ts_nanos) AS exit_ts, CASE WHEN min(ex.ts_nanos) IS NULL THEN 'open' WHEN min(en.ts_nanos) IS NULL THEN 'orphan_exit' ELSE 'complete' END AS status, "
    "min(ex.ts_nanos) - min(en.ts_nanos) AS duration_ns FROM en FULL JOIN ex USING (instance_id, span_id) GROUP BY ALL"
)
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    enters, exits = _span_records(spark, sf_dir)
    return spans.summary(enters.unionByName(exits))


@query(
    _SPANS + ", al AS (SELECT *, 'enter' AS phase FROM en UNION ALL SELECT *, 'exit' FROM ex), pl AS (SELECT instance_id, shard_id, ts_nanos, event AS name FROM s WHERE row_id % 70 = 0), "
    "la AS (SELECT greatest((SELECT max(ts_nanos) FROM al), (SELECT max(ts_nanos) FROM pl)) AS m), "
    "h AS (SELECT al.*, CASE WHEN phase = 'enter' THEN EXISTS (SELECT 1 FROM ex WHERE ex.instance_id = al.instance_id AND ex.span_id = al.span_id) ELSE EXISTS (SELECT 1 FROM en WHERE en.instance_id = al.instance_id AND en.span_id = al.span_id) END AS other FROM al), "
    "ev AS (SELECT CASE WHEN phase = 'enter' THEN 'b' WHEN other THEN 'e' ELSE 'i' END AS ph, name, CASE WHEN phase = 'enter' OR other THEN span_id END AS sid, instance_id, shard_id, ts_nanos, CASE WHEN phase = 'exit' AND NOT other THEN 'orphan_exit' END AS mark FROM h "
    "UNION ALL SELECT 'e', name, span_id, instance_id, shard_id, la.m, 'open' FROM h, la WHERE phase = 'enter' AND NOT other UNION ALL SELECT 'i', name, NULL, instance_id, shard_id, ts_nanos, NULL FROM pl) "
    "SELECT ph, name, split_part(name, '::', 1) AS cat, '0x' || lpad(lower(printf('%X', sid)), 16, '0') AS id, instance_id AS pid, shard_id AS tid, CAST(ts_nanos AS DOUBLE) / 1000 AS ts, ts_nanos, mark FROM ev"
)
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and plain events as trace events, with made-up ends where a half is missing."""
    enters, exits = _span_records(spark, sf_dir)
    plain = stream(spark, sf_dir).where("row_id % 70 = 0").select("instance_id", "shard_id", F.lit(None).cast("long").alias("span_id"), "ts_nanos", F.lit("none").alias("phase"), F.col("event").alias("name"))
    return spans.trace_events(enters.unionByName(exits).unionByName(plain))


@query(
    ", k AS (SELECT row_id % 3 AS instance_id, row_id // 3 AS span_id, CASE WHEN row_id >= 3 THEN row_id // 6 END AS parent_span_id FROM s), "
    "t(instance_id, span_id, parent_span_id, depth, root_id) AS (SELECT instance_id, span_id, parent_span_id, 0, span_id FROM k WHERE parent_span_id IS NULL "
    "UNION ALL SELECT k.instance_id, k.span_id, k.parent_span_id, t.depth + 1, t.root_id FROM k JOIN t ON k.instance_id = t.instance_id AND k.parent_span_id = t.span_id) SELECT * FROM t"
)
def span_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of every span in the trees of three instances that use the same ids."""
    s = stream(spark, sf_dir)
    span, parent = F.expr("row_id div 3").alias("span_id"), F.expr("CASE WHEN row_id >= 3 THEN row_id div 6 END").alias("parent_span_id")
    return spans.tree(s.select((F.col("row_id") % 3).alias("instance_id"), span, parent))


# ---- retention and dump policies


@query(f"SELECT row_id, instance_id, shard_id FROM (SELECT *, sum(32 + 18) OVER (PARTITION BY instance_id, shard_id ORDER BY row_id DESC) AS held FROM s) WHERE held <= {_RING}")
def ring_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rings of 8 KiB still hold at the end."""
    return retention.retained(stream(spark, sf_dir), _RING, F.lit(32).cast("long"), "row_id").select("row_id", "instance_id", "shard_id")


@query("SELECT row_id, CASE WHEN user_id % 8 = 0 THEN 0 ELSE user_id % 8 END AS shard FROM s")
def shard_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("row_id", retention.shard_of(F.col("user_id"), 8).alias("shard"))


@query(
    "SELECT s.row_id, s.instance_id FROM s WHERE coalesce((SELECT arg_max(w.on_, w.ts_nanos) FROM (SELECT ts_nanos, instance_id, row_id % 2 = 0 AS on_ FROM s WHERE event_type = 'signup') w WHERE w.instance_id = s.instance_id AND w.ts_nanos <= s.ts_nanos), true)"
)
def enable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made while recording was on; signups switch it."""
    s = stream(spark, sf_dir)
    switches = s.where("event_type = 'signup'").select("instance_id", F.col("ts_nanos").alias("at"), (F.col("row_id") % 2 == 0).alias("on"))
    return retention.enabled(s.select("row_id", "instance_id", "ts_nanos"), switches).select("row_id", "instance_id")


@query("SELECT row_id, instance_id FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ts_nanos, row_id) AS n FROM s WHERE event_type = 'error') WHERE n <= 8")
def limit_keep_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.keep_oldest(stream(spark, sf_dir).where("event_type = 'error'"), 8, at=("ts_nanos", "row_id")).select("row_id", "instance_id")


@query("SELECT row_id, instance_id FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ts_nanos DESC, row_id DESC) AS n FROM s WHERE event_type = 'error') WHERE n <= 8")
def limit_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.keep_newest(stream(spark, sf_dir).where("event_type = 'error'"), 8, at=("ts_nanos", "row_id")).select("row_id", "instance_id")


@query(
    ", q AS (SELECT row_id, instance_id, ts_nanos, row_number() OVER (PARTITION BY instance_id ORDER BY ts_nanos, row_id) AS n FROM s WHERE event_type = 'error'), "
    f"f AS (SELECT row_id, instance_id, n, ts_nanos AS last, true AS accepted FROM q WHERE n = 1 UNION ALL SELECT q.row_id, q.instance_id, q.n, CASE WHEN q.ts_nanos - f.last >= {6 * _HOUR} THEN q.ts_nanos ELSE f.last END, "
    f"q.ts_nanos - f.last >= {6 * _HOUR} FROM q JOIN f ON q.instance_id = f.instance_id AND q.n = f.n + 1) SELECT row_id, instance_id, accepted FROM f"
)
def throttle_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump requests (errors) under a throttle of six hours: each decision depends on the one before."""
    requests = stream(spark, sf_dir).where("event_type = 'error'").select("row_id", "instance_id", "ts_nanos")
    return retention.accepted(requests, 6 * _HOUR).select("row_id", "instance_id", "accepted")


# ---- dumps


def _write(spark: SparkSession, sf_dir: str, keep=None) -> str:
    """The stream as a dump file; returns its path."""
    whole = stream(spark, sf_dir)
    s = whole if keep is None else whole.where(keep)
    # of the whole stream, as all snapshots of an instance share one table
    texts = whole.select("instance_id", "props").distinct().withColumn("id", F.row_number().over(Window.partitionBy("instance_id").orderBy("props")).cast("long") - 1)
    tables: dict[int, list[tuple[int, bytes]]] = {}
    for r in texts.orderBy("instance_id", "id").toLocalIterator():  # intern tables are headers: small by nature
        tables.setdefault(r.instance_id, []).append((r.id, r.props.encode()))
    known = texts.withColumnRenamed("id", "text_id")
    rows = s.join(known, ["instance_id", "props"]).drop("props").withColumnRenamed("text_id", "props")
    records = None
    for name in TYPES:
        t = event_type(name)
        part = encoded(rows.where(F.col("event_type") == name).select("ts_nanos", "instance_id", "shard_id", "row_id", "user_id", "value_cents", "props"), t)
        part = part.select("ts_nanos", ids.u64(t.id).alias("event_id"), "instance_id", "shard_id", "fields", F.col("row_id").alias("arrival"))
        records = part if records is None else records.unionByName(part)
    folder = f"{scratch(spark)}/tracewell"
    os.makedirs(folder, exist_ok=True)
    out = f"{folder}/{uuid.uuid4().hex}.dump"
    engine.write_dump(records, registry(), tables, {i: f"host-{i}" for i in tables}, out)
    return out


@query("SELECT row_number() OVER (ORDER BY ts_nanos, instance_id, shard_id, row_id) - 1 AS seq, ts_nanos, event, instance_id, row_id, user_id, value_cents, props FROM s")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream written as a dump, read, merged and decoded again."""
    w = engine.load(spark, _write(spark, sf_dir)).events()
    pick = lambda f: F.coalesce(*[F.col(f"`app::{t}`.{f}") for t in TYPES]).alias(f)
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return w.select("seq", long("ts_nanos"), "event", long("instance_id"), long("row_id"), long("user_id"), pick("value_cents"), pick("props"))


@query("SELECT event, count(*) AS records FROM s GROUP BY event")
def dump_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by name in a dump, before identity counts."""
    return engine.counts(engine.load(spark, _write(spark, sf_dir)))[0]


@query("SELECT instance_id, shard_id, count(*) AS records FROM s GROUP BY ALL")
def dump_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump merged with itself: every record once, in rings of the same instances and shards."""
    path = _write(spark, sf_dir)
    merged = engine.merge(spark, [path, path], f"{path}.merged")
    rows = engine.load(spark, merged).records()
    return rows.groupBy(F.col("instance_id").cast("bigint").alias("instance_id"), "shard_id").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT instance_id, 2 * count(*) AS raw_records, count(*) AS unique_records FROM s GROUP BY instance_id")
def dump_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump spliced to itself: every record twice until identity counts."""
    path = _write(spark, sf_dir)
    both = engine.load(spark, engine.merge(spark, [path, path], f"{path}.spliced", dedup=False))
    n = lambda dedup, name: both.records(dedup=dedup).groupBy(F.col("instance_id").cast("bigint").alias("instance_id")).agg(F.count(F.lit(1)).alias(name))
    return n(False, "raw_records").join(n(True, "unique_records"), "instance_id")


# ---- converted files

_TABLE = "SELECT ts_nanos, event, instance_id, row_id, user_id, value_cents, props FROM s"


def _table(spark: SparkSession, paths: list[str], seq: bool = False) -> DataFrame:
    """Dumps converted to a table, read again and laid flat."""
    w = spark.read.parquet(engine.convert(spark, paths, f"{paths[0]}.{uuid.uuid4().hex}.parquet"))
    pick = lambda f: F.coalesce(*[F.col(f"`app::{t}`.{f}") for t in TYPES]).alias(f)
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return w.select(*["seq"] * seq, long("ts_nanos"), "event", long("instance_id"), long("row_id"), long("user_id"), pick("value_cents"), pick("props"))


@query(_TABLE.replace("SELECT", "SELECT row_number() OVER (ORDER BY ts_nanos, instance_id, shard_id, row_id) - 1 AS seq,"))
def convert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump converted to Parquet, as other readers find it."""
    return _table(spark, [_write(spark, sf_dir)], seq=True)


@query(_TABLE)
def convert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dumps, one of which is given twice, converted to one table: each record once."""
    even, odd = _write(spark, sf_dir, F.col("row_id") % 2 == 0), _write(spark, sf_dir, F.col("row_id") % 2 == 1)
    return _table(spark, [even, odd, even])


@query(_TABLE)
def merge_then_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a merged dump: the table is that of all dumps converted at once."""
    even, odd = _write(spark, sf_dir, F.col("row_id") % 2 == 0), _write(spark, sf_dir, F.col("row_id") % 2 == 1)
    return _table(spark, [engine.merge(spark, [even, odd, even], f"{even}.merged")])


@query("SELECT 'format' AS key, '1' AS value FROM s UNION SELECT 'host', 'host-0' FROM s UNION SELECT 'views', event FROM s")
def convert_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a converted table's footer says: its format, its host, and the events that its views are of."""
    out = engine.convert(spark, [path := _write(spark, sf_dir)], f"{path}.parquet")
    said = {k.rpartition(".")[2]: v for k, v in engine.footer_of(out).items()}
    rows = [(k, v) for k, v in said.items() if k != "views"] + [("views", f"app::{t}") for t in TYPES if f'VIEW "app::{t}"' in said["views"]]
    return spark.createDataFrame(rows, "key string, value string")


def _write_spans(spark: SparkSession, sf_dir: str) -> str:
    """Enters and exits of the stream as a dump; returns its path."""
    labels = ((0, "Idle"), (1, "Busy"))
    kinds = [
        event(f"work::{half}", Declared("span", "u64", role="span_id"), Declared("code", "u32", sentinel=0), Declared("state", "enum", labels=labels), Declared("delta", "i32", sentinel=-1), phase=phase)
        for half, phase in (("Start", "enter"), ("End", "exit"))
    ]
    records = None
    for t, rows in zip(kinds, _span_records(spark, sf_dir)):
        n = F.col("span_id")
        rows = rows.select("ts_nanos", "instance_id", "shard_id", n.alias("span"), (n % 3).alias("code"), (n % 4).alias("state"), (n % 5 - 2).alias("delta"))
        part = encoded(rows, t).select("ts_nanos", ids.u64(t.id).alias("event_id"), "instance_id", "shard_id", "fields", F.col("span").alias("arrival"))
        records = part if records is None else records.unionByName(part)
    folder = f"{scratch(spark)}/tracewell"
    os.makedirs(folder, exist_ok=True)
    out = f"{folder}/{uuid.uuid4().hex}.dump"
    engine.write_dump(records, Registry.of(kinds), {}, {}, out)
    return out


_SPAN_EVENTS = (
    _SPANS + ", la AS (SELECT greatest((SELECT max(ts_nanos) FROM en), (SELECT max(ts_nanos) FROM ex)) AS m), "
    "ev AS (SELECT 'b' AS ph, 'work::Start' AS name, * EXCLUDE (name), NULL AS mark FROM en "
    "UNION ALL SELECT 'e', 'work::Start', instance_id, shard_id, span_id, m, 'open' FROM en ANTI JOIN ex USING (instance_id, span_id), la "
    "UNION ALL SELECT 'e', 'work::End', * EXCLUDE (name), NULL FROM ex SEMI JOIN en USING (instance_id, span_id) "
    "UNION ALL SELECT 'i', 'work::End', * EXCLUDE (name), 'orphan_exit' FROM ex ANTI JOIN en USING (instance_id, span_id)) "
)


@query(
    _SPAN_EVENTS + "SELECT ph, name, 'work' AS cat, CASE WHEN ph <> 'i' THEN '0x' || lpad(lower(printf('%X', span_id)), 16, '0') END AS id, instance_id AS pid, shard_id AS tid, CAST(ts_nanos AS DOUBLE) / 1000 AS ts, "
    "span_id AS span, span_id % 3 AS code, CASE span_id % 4 WHEN 0 THEN 'Idle' WHEN 1 THEN 'Busy' ELSE CAST(span_id % 4 AS VARCHAR) END AS state, span_id % 5 - 2 AS delta, mark FROM ev"
)
def trace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of spans converted to a trace, as a viewer finds it; arguments show absent values as they were recorded."""
    out = engine.convert(spark, [path := _write_spans(spark, sf_dir)], f"{path}.json")
    args = f"struct<span: bigint, code: bigint, state: string, delta: bigint, {spans.OPEN}: boolean, {spans.ORPHAN}: boolean>"
    one = f"struct<ph: string, name: string, cat: string, id: string, pid: bigint, tid: bigint, ts: double, args: {args}>"
    at = engine.read_trace(spark, out, one)
    mark = F.when(F.col(f"args.{spans.OPEN}"), "open").when(F.col(f"args.{spans.ORPHAN}"), "orphan_exit").alias("mark")
    return at.select("ph", "name", "cat", "id", "pid", "tid", "ts", "args.span", "args.code", "args.state", "args.delta", mark)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the wide table, numbered in merged order and counted."""
    # numbering keeps its rows in a checkpoint: only the columns asked for go into it
    w = sets.numbered(_wide(spark, sf_dir).select("event", *sets.IDENTITY))
    return w.groupBy("event").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT event, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT event, row_number() OVER (ORDER BY ts_nanos, instance_id, shard_id, phys_offset) - 1 AS seq FROM s) GROUP BY event")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP(spark, sf_dir)
