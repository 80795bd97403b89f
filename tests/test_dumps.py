"""Format, rings, registries and whole files."""

import json
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell import engine
from tracewell.__main__ import main
from tracewell.functions import ids
from tracewell.operators import views, wide
from tracewell.sources import dump_source, footers, wire
from tracewell.sources.ring import WRAPPED, Ring, packed, repacked, walk, walk_pieces
from tracewell.sources.schema import Declared, EventType, Field, Registry, content_id, event


# ---- ids


def test_fnv_vectors():
    assert ids.fnv1a64(b"") == 0xCBF29CE484222325
    assert ids.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert ids.fnv1a64(b"foobar") == 0x85944171F73967E8


def test_content_ids():
    demo = event("test::Demo", Declared("packet_number", "u64", role="key"))
    assert demo.id == 0x544E12694249631B
    roles = ((0, "Client"), (1, "Server"))
    connect = event("test::net::Connect", Declared("conn_id", "u64", role="key", description="The connection id."), Declared("window", "u32", unit="bytes"), Declared("role", "enum", labels=roles), Declared("_pad", "bytes", width=3))
    assert (connect.id, connect.record_size) == (0x48DD17CE769614BD, 16)
    start = event("test::work::RequestStart", Declared("span", "u64", role="span_id"), Declared("parent", "u64", role="parent_span_id"), phase="enter")
    end = event("test::work::RequestEnd", Declared("span", "u64", role="span_id"), Declared("bytes", "u64", description="Bytes written during the request — captured at drop time."), phase="exit")
    assert (start.id, end.id) == (0x9B17BD95F3F761F1, 0x5ACEEDC21C208ADA)
    changed = event("test::Demo", Declared("packet_number", "u64", role="key", sentinel=0))
    assert changed.id != demo.id


def test_stamps():
    assert ids.utc_stamp(0) == "19700101T000000000Z"
    assert ids.utc_stamp(1782224730123) == "20260623T142530123Z"
    assert ids.utc_stamp(1709164800000) == "20240229T000000000Z"
    one = ids.utc_stamp(5)
    two = ids.utc_stamp(5, one)
    assert two == one + "-1" and ids.utc_stamp(5, two) == one + "-2" and ids.utc_stamp(6, two) == "19700101T000000006Z"


def test_columns_of_ids(spark):
    row = spark.range(1).select(
        ids.id_text(ids.u64(2**64 - 1)), ids.hex16(ids.u64(0)), ids.category(F.lit("a::b::c")),
        ids.span_counter(ids.u64((5 << 16) | 7)), ids.span_seed(ids.u64((5 << 16) | 7)), ids.signed_image(ids.u64(2**63)), ids.pow2_ceiling(F.lit(51)),
    ).first()
    assert tuple(row) == ("0xffffffffffffffff", "0" * 16, "a", Decimal(5), 7, 0, 64)
    assert ids.compose_span_id(5, 7) == (5 << 16) | 7 and ids.mix64(1) != ids.mix64(2) and [ids.next_pow2(n) for n in (0, 1, 2, 3, 64, 65)] == [1, 1, 2, 4, 64, 128]


# ---- declarations


@pytest.mark.parametrize(
    "make",
    [
        lambda: event("plain", Declared("a", "u8")),
        lambda: event("a::b", Declared("a", "f32")),
        lambda: event("a::b", Declared("a", "bytes")),
        lambda: event("a::b", Declared("a", "u32", role="span_id"), phase="enter"),
        lambda: event("a::b", Declared("a", "u64", role="span_id"), Declared("b", "u64", role="span_id"), phase="enter"),
        lambda: event("a::b", Declared("a", "u64"), phase="exit"),
        lambda: event("a::b", Declared("a", "u64", role="span_id")),
        lambda: event("a::b", Declared("a", "bool", sentinel=1)),
        lambda: event("a::b", Declared("a", "enum", repr="i8")),
        lambda: event("a::b", Declared("a", "enum", labels=((300, "X"),))),
        lambda: event("a::b", Declared("a", "bytes", width=70_000)),
    ],
)
def test_faulty_declarations(make):
    with pytest.raises(ValueError):
        make()


def test_display_names_of_versions():
    a, b = EventType("ns::E", (), 0, id=0xAA), EventType("ns::E", (), 0, id=0xBB)
    reg = Registry.of([a], [b, a])
    assert reg.display_names() == {0xAA: "ns::E#00000000000000aa", 0xBB: "ns::E#00000000000000bb"}


# ---- rings


SIZES = {7: 8}


def u64(n):
    return struct.pack("<Q", n)


def test_newest_win_and_the_boundary_is_crossed():
    ring = Ring(128)
    for i in range(20):
        ring.push(i, 7, u64(i))
    got = list(walk(bytes(ring.region), ring.head, ring.capacity, SIZES))
    times = [g[0] for g in got]
    assert times == list(range(19, 19 - len(times), -1)) and len(times) == 128 // 26
    assert any(g[2] == WRAPPED for g in got) or all(g[3] == u64(g[0]) for g in got)


def test_damage_costs_only_what_it_hit():
    ring = Ring(4096)
    for i in range(6):
        ring.push(i, 7, u64(i))
    ring.region[ring.head - 10 : ring.head] = b"\x77" * 10
    assert [g[0] for g in walk(bytes(ring.region), ring.head, ring.capacity, SIZES)] == [4, 3, 2, 1, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 9), st.lists(st.integers(0, 40), max_size=60))
def test_walk_keeps_what_fits(bits, sizes):
    ring, kinds, written = Ring(1 << bits), {}, []
    for i, n in enumerate(sizes):
        if n + 18 > ring.capacity:
            continue
        kinds[1000 + n] = n
        start = ring.push(i, 1000 + n, bytes([i % 251]) * n)
        written.append((start, i, 1000 + n, bytes([i % 251]) * n))
    low = max(0, ring.head - ring.capacity)
    want = [(i, k, f) for s, i, k, f in reversed(written) if s >= low]
    got = [(t, k, f) for t, k, _, f in walk(bytes(ring.region), ring.head, ring.capacity, kinds)]
    assert got[: len(want)] == want


def test_odd_regions():
    assert list(walk(b"\0" * 100, 50, 100, SIZES)) == [] and list(walk(b"\0" * 64, 50, 128, SIZES)) == [] and list(walk(b"", 0, 0, SIZES)) == []
    region, head = repacked([(1, 7, u64(1)), (2, 7, u64(2))])
    assert (len(region), head) == (64, 52)
    assert [(t, o) for t, _, o, _ in walk(region, head, 64, SIZES)] == [(2, 26), (1, 0)]
    with pytest.raises(ValueError):
        Ring(32).push(0, 7, b"x" * 60)


class Watched:
    """A region of a ring in which the longest stretch read at once is noted."""

    def __init__(self, ring):
        self.region, self.most = bytes(ring.region), 0

    def __call__(self, begin, n):
        assert begin + n <= len(self.region)
        self.most = max(self.most, n)
        return self.region[begin : begin + n]


@pytest.mark.parametrize("pushed", [3, 500, 2000])
def test_a_ring_is_read_in_pieces(pushed):
    ring, kinds = Ring(1 << 14), {7: 8, 8: 0, 9: 31}
    for i in range(pushed):
        ring.push(i, 7 + i % 3, bytes([i % 251]) * kinds[7 + i % 3])
    at = ring.head - ring.capacity // 3 & ring.capacity - 1
    ring.region[at : at + 40] = b"\x77" * len(ring.region[at : at + 40])  # damage
    want = list(walk(bytes(ring.region), ring.head, ring.capacity, kinds))
    for piece in (1, 50, 100, 1000):
        region = Watched(ring)
        assert list(walk_pieces(region, ring.head, ring.capacity, kinds, piece)) == want
        assert region.most <= max(piece, 31 + 18)


def test_packed_columns():
    rows = [(2**63 + i, 2**64 - 1 - i, bytes([i]) * (i % 4 * 5)) for i in range(50)]
    bits = lambda k: np.array([r[k] for r in rows], np.uint64).view(np.int64)
    fields = pa.array([b"x" * 9, *[r[2] for r in rows]], pa.binary()).slice(1)
    body, head = repacked(rows)
    assert packed(bits(0), bits(1), fields) == body[:head]
    assert packed(bits(0)[:0], bits(1)[:0], fields[:0]) == b"" and packed(bits(0)[3:4], bits(1)[3:4], fields[3:4]) == repacked(rows[3:4])[0][:33]
    with pytest.raises(ValueError):
        packed(bits(0)[:1], bits(1)[:1], pa.array([b"x" * 65_530]))
    with pytest.raises(ValueError):
        packed(bits(0)[:1], bits(1)[:1], pa.array([None], pa.binary()))


# ---- format


def all_sections():
    t = event("a::b", Declared("k", "u64", role="key", sentinel=0, description="d", unit="u"), Declared("e", "enum", labels=((1, "One"),), repr="u16"), Declared("i", "interned", dynamic=True), description="about")
    return t, [(wire.SCHEMA, wire.types_body([t])), (wire.INTERN, wire.intern_body(2**63 + 1, [(5, b"alpha"), (6, b"\xff")])), (wire.VIEWS, b"SELECT 1"), (wire.META, wire.meta_body(9, "host")), (77, b"unknown"), (wire.SHARD, wire.shard_body(9, 3, 10, b"\0" * 16))]


def test_sections_come_back():
    t, sections = all_sections()
    d = wire.Dump(wire.assemble(sections))
    assert d.types() == [t] and d.interns() == [(2**63 + 1, [(5, b"alpha"), (6, b"\xff")])] and d.views() == ["SELECT 1"] and d.metas() == [(9, "host")] and d.flags == 1
    (h, region), = d.shards()
    assert (h.instance_id, h.shard_id, h.head, h.capacity, region) == (9, 3, 10, 16, b"\0" * 16)
    empty = wire.Dump(wire.assemble([]))
    assert empty.types() == empty.interns() == empty.metas() == empty.views() == empty.shards() == []


def test_faulty_dumps():
    data = wire.assemble(all_sections()[1])
    for broken, kind in ((b"nope", "UnexpectedEof"), (b"", "UnexpectedEof"), (b"X" + data[1:], "BadMagic"), (data[:8] + b"\2" + data[9:], "UnsupportedVersion"), (data[:-4], "SectionOutOfBounds")):
        with pytest.raises(wire.DumpError) as e:
            wire.Dump(broken)
        assert e.value.kind == kind
    with pytest.raises(wire.DumpError):  # a forged count reads no further than the bytes there are
        wire.read_types(struct.pack("<I", 2**32 - 1))
    with pytest.raises(wire.DumpError) as e:
        wire.read_types(wire.types_body([event("a::b", Declared("k", "u8"))]).replace(b"\1\0k\0\0", b"\1\0k\0\x63"))
    assert e.value.kind == "BadTag"
    with pytest.raises(wire.DumpError) as e:
        wire.read_meta(struct.pack("<QH", 1, 1) + b"\xff")
    assert e.value.kind == "InvalidUtf8"


# ---- whole files

ROLE = Declared("role", "enum", labels=((0, "Client"), (1, "Server")))
CONNECT = event("test::net::Connect", Declared("conn_id", "u64", role="key"), Declared("window", "u32"), ROLE, Declared("_pad", "bytes", width=3))
PACKET = event("test::net::PacketSent", Declared("conn_id", "u64", role="key"), Declared("packet_number", "u64", role="key"), Declared("len", "u32"), Declared("is_fin", "bool"), Declared("_pad", "bytes", width=3))
FRAME = event("test::net::Frame", Declared("dump_id", "u64", role="key", sentinel=0), Declared("offset", "u64", sentinel=2**64 - 1), Declared("code", "i32", sentinel=-1), Declared("why", "interned"))
START = event("test::work::Start", Declared("span", "u64", role="span_id"), Declared("parent", "u64", role="parent_span_id"), phase="enter")
END = event("test::work::End", Declared("span", "u64", role="span_id"), Declared("bytes", "u64"), phase="exit")
TYPES = [CONNECT, PACKET, FRAME, START, END]
BIG = 2**63 + 5


def dump(path, records, instance=1, shard=0, host="box", interns=(), extra=(), capacity=1 << 16, ring=None):
    ring = ring or Ring(capacity)
    for ts, t, fields in records:
        assert len(fields) == t.record_size
        ring.push(ts, t.id, fields)
    sections = [(wire.SCHEMA, wire.types_body(TYPES)), (wire.INTERN, wire.intern_body(instance, interns)), *extra, (wire.SHARD, wire.shard_body(instance, shard, ring.head, bytes(ring.region))), (wire.META, wire.meta_body(instance, host))]
    path.write_bytes(wire.assemble(sections))
    return ring


def connect(conn, role=1):
    return struct.pack("<QIB3x", conn, 4096, role)


def packet(conn, n, fin=0):
    return struct.pack("<QQIB3x", conn, n, 1200, fin)


def three(conn=BIG):
    return [(1000, CONNECT, connect(conn)), (1010, PACKET, packet(conn, 0)), (1020, PACKET, packet(conn, 1, 1))]


def test_convert_and_query(spark, tmp_path):
    a = tmp_path / "a.dump"
    dump(a, three(), extra=[(wire.VIEWS, b"SELECT 'registered'")])
    out = engine.convert(spark, [str(a)], str(tmp_path / "a.parquet"), level=5)
    t = spark.read.parquet(out)
    assert t.columns == [*wide.DENSE, *"conn_id dump_id packet_number span parent test::net::Connect test::net::Frame test::net::PacketSent test::work::End".split()]
    rows = t.orderBy("seq").collect()
    assert [(r.seq, int(r.ts_nanos), r.event) for r in rows] == [(0, 1000, "test::net::Connect"), (1, 1010, "test::net::PacketSent"), (2, 1020, "test::net::PacketSent")]
    assert rows[0]["test::net::Connect"].asDict() == {"window": Decimal(4096), "role": "Server", "_pad": "000000"} and rows[0]["test::net::PacketSent"] is None
    assert rows[2]["test::net::PacketSent"].is_fin is True and int(rows[1].conn_id) == BIG
    assert t.schema["conn_id"].metadata == {f"{wire.PREFIX}.role": "key"}
    footer = engine.footer_of(out)
    assert footer[f"{wire.PREFIX}.host"] == "box" and footer[f"{wire.PREFIX}.format"] == "1" and "registered" in footer[f"{wire.PREFIX}.views"]
    assert "read_parquet('a.parquet/*.parquet')" in (tmp_path / "a.parquet.views.sql").read_text()
    names = engine.load(spark, str(a)).register()
    assert spark.sql("SELECT count(*) FROM `test::net::PacketSent`").first()[0] == 2
    assert spark.sql("SELECT event FROM `test::net::Connect` WHERE `test::net::Connect`.role = 'Server'").count() == 1
    assert {tuple(r) for r in spark.table(views.MANIFEST).collect()} >= {("test::net::Connect", "conn_id", "key"), ("test::work::Start", "parent", "parent_span_id")}
    assert "events" in names
    pushed = views.event_view(t, CONNECT.id)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id" in pushed


def test_ddl_in_duckdb(spark, tmp_path):
    import duckdb

    a = tmp_path / "a.dump"
    dump(a, three())
    out = engine.convert(spark, [str(a)], str(tmp_path / "a.parquet"))
    con = duckdb.connect()
    con.execute(views.ddl(Registry.of(TYPES), bind=f"{out}/*.parquet"))
    assert con.execute('SELECT count(*) FROM "test::net::PacketSent"').fetchone() == (2,)
    assert con.execute(f"SELECT count(*) FROM {views.MANIFEST}").fetchone()[0] == len(wide.Plan(Registry.of(TYPES)).keys())
    con.execute(views.ddl(Registry.of([event("a::b", Declared("x", "u8"))]), bind=f"{out}/*.parquet"))
    assert con.execute(f"SELECT * FROM {views.MANIFEST}").fetchall() == []
    assert views.quote('a`"b') == '`a``"b`' and views.quote_double('a"b') == '"a""b"' and views.quote_text("o'n") == "'o''n'"


def test_sentinels_and_interns(spark, tmp_path):
    a = tmp_path / "a.dump"
    pack = lambda d, o, c, w: struct.pack("<QQiI", d, o, c, w)
    dump(a, [(1000, FRAME, pack(0, 2**64 - 1, -1, 5)), (1010, FRAME, pack(42, 100, 5, 6)), (1020, FRAME, pack(1, 2**63, -7, 9))], instance=BIG, interns=[(5, b"first"), (5, b"alpha"), (6, b"\xffbeta")])
    rows = engine.load(spark, str(a)).events().orderBy("seq").collect()
    got = [(r.dump_id, r["test::net::Frame"].offset, r["test::net::Frame"].code, r["test::net::Frame"].why) for r in rows]
    assert got == [(None, None, None, "alpha"), (42, 100, 5, "�beta"), (1, 2**63, -7, "#9")]
    assert {int(r.instance_id) for r in rows} == {BIG}


def test_interns_are_an_instances_own(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    row = [(1, FRAME, struct.pack("<QQiI", 1, 1, 1, 5))]
    dump(a, row, instance=1, interns=[(5, b"alpha")])
    dump(b, row, instance=2, interns=[(5, b"bravo")])
    rows = engine.load(spark, str(a), str(b)).events().collect()
    assert {(int(r.instance_id), r["test::net::Frame"].why) for r in rows} == {(1, "alpha"), (2, "bravo")}


def test_merge_and_splice(spark, tmp_path):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    ring = dump(a, [(1000 + i, PACKET, packet(1, i)) for i in range(3)])
    dump(b, [(1003 + i, PACKET, packet(1, i + 3)) for i in range(3)], ring=ring)
    both = engine.load(spark, str(a), str(b))
    assert (both.raw().count(), both.records().count()) == (9, 6)
    merged = engine.merge(spark, [str(a), str(b)], str(tmp_path / "m.dump"))
    d = wire.Dump((tmp_path / "m.dump").read_bytes())
    (h, region), = d.shards()
    assert h.head == 6 * 42 and h.capacity == 256 and d.metas() == [(1, "box")]
    assert [t for t, *_ in walk(region, h.head, h.capacity, {PACKET.id: 24})] == [1005, 1004, 1003, 1002, 1001, 1000]
    assert engine.load(spark, merged).events().count() == 6
    spliced = engine.merge(spark, [str(a), str(b)], str(tmp_path / "s.dump"), dedup=False)
    again = engine.load(spark, spliced)
    assert (again.raw().count(), again.records().count(), len(again.headers[0].metas)) == (9, 6, 2)
    with pytest.raises(ValueError):
        engine.merge(spark, [str(a)], str(tmp_path / "x"))


def test_a_ring_is_written_by_many_tasks(spark, tmp_path):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    dump(a, [(1000 + i, (PACKET, CONNECT)[i % 2], packet(1, i) if i % 2 == 0 else connect(i)) for i in range(600)])
    dump(b, [(5000 - i, PACKET, packet(2, i)) for i in range(300)], shard=1)
    writer = dump_source.DumpWriter({"out": str(tmp_path / "w.dump"), "token": "t"})
    records = engine.load(spark, str(a), str(b), str(a)).unique_raw().orderBy("shard_id", "ts_key", "phys_offset").toPandas()
    records["place"] = range(len(records))
    batches = [pa.RecordBatch.from_pandas(records.iloc[i : i + 70]) for i in range(0, len(records), 70)]
    parts = [writer.write(iter(batches[k : k + 3])) for k in range(0, len(batches), 3)]
    writer.commit(parts[::-1])
    assert len(parts) > 3 and sum(len(p.pieces) for p in parts) > len(parts)
    before = wire.Dump((tmp_path / "w.dump").read_bytes())
    assert before.sections[-1].offset + before.sections[-1].length == len(before.data)
    engine.merge(spark, [str(a), str(b), str(a)], str(tmp_path / "m.dump"))
    rings = lambda name: [(h.shard_id, h.head, h.capacity, region) for h, region in wire.Dump((tmp_path / name).read_bytes()).shards()]
    assert rings("m.dump") == rings("w.dump") and [r[0] for r in rings("m.dump")] == [0, 1]
    _, head, capacity, region = rings("m.dump")[1]
    assert [t for t, *_ in walk(region, head, capacity, {PACKET.id: 24})] == [5000 - i for i in range(300)]


def test_footers_keep_all_else(tmp_path):
    table = pa.table({"n": pa.array(range(1000), pa.int64()), "t": [f"é{i}" for i in range(1000)], "d": pa.array([Decimal(i) for i in range(1000)], pa.decimal128(20, 0))})
    source, out = str(tmp_path / "s.parquet"), str(tmp_path / "o.parquet")
    pq.write_table(table.replace_schema_metadata({f"k{i}": "old" for i in range(20)}), source, row_group_size=100, compression="zstd", write_page_index=True)
    footers.copy_with_keys(source, out, {"k3": "new", "long": "é" * 70_000})
    said = pq.read_metadata(out).metadata
    assert said[b"k3"] == b"new" and said[b"long"].decode() == "é" * 70_000 and said[b"k4"] == b"old" and said.keys() == pq.read_metadata(source).metadata.keys() | {b"long"}
    assert pq.read_table(out).equals(table) and pq.read_metadata(out).num_row_groups == 10
    assert [pq.read_metadata(out).row_group(3).column(k).to_dict() for k in range(3)] == [pq.read_metadata(source).row_group(3).column(k).to_dict() for k in range(3)]
    size = len((tmp_path / "s.parquet").read_bytes()) - 8 - pq.read_metadata(source).serialized_size
    assert (tmp_path / "o.parquet").read_bytes()[:size] == (tmp_path / "s.parquet").read_bytes()[:size]
    pq.write_table(pa.table({"n": [1]}), source, store_schema=False)
    footers.copy_with_keys(source, out, {"a": "b"})
    assert pq.read_metadata(out).metadata == {b"a": b"b"} and pq.read_table(out).to_pylist() == [{"n": 1}]
    (tmp_path / "s.parquet").write_bytes(b"PAR1 no footer PARE")
    with pytest.raises(ValueError):
        footers.copy_with_keys(source, out, {})


def test_two_recorders_and_shards_in_order(spark, tmp_path):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    dump(a, three(), instance=7, shard=1)
    dump(b, three(), instance=BIG, shard=0)
    rows = engine.load(spark, str(b), str(a)).events().orderBy("seq").collect()
    assert [(int(r.ts_nanos), int(r.instance_id)) for r in rows] == [(t, i) for t in (1000, 1010, 1020) for i in (7, BIG)]
    hosts = engine.load(spark, str(a), str(b)).hosts
    assert hosts == {7: "box", BIG: "box"}


def test_trace(spark, tmp_path):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    span = lambda t, s, x: struct.pack("<QQ", s, x)
    dump(a, [(100, START, span(0, 9, 0)), (120, START, span(0, 10, 9)), (130, END, span(0, 11, 1)), (150, END, span(0, 9, 4096)), (160, CONNECT, connect(3, 9))])
    dump(b, [], instance=2)
    out = engine.convert(spark, [str(a), str(b)], str(tmp_path / "t.json"))
    doc = json.loads((tmp_path / "t.json").read_text())
    assert doc["displayTimeUnit"] == "ns" and len(doc["traceEvents"]) == 6 and out.endswith("t.json")
    by = {(e["ph"], e["name"], e["ts"]): e for e in doc["traceEvents"]}
    begin, end = by["b", "test::work::Start", 0.1], by["e", "test::work::End", 0.15]
    assert begin["id"] == end["id"] == "0x0000000000000009" and end["args"]["bytes"] == 4096 and begin["cat"] == "test" and (begin["pid"], begin["tid"]) == (1, 0)
    assert by["e", "test::work::Start", 0.16]["args"][f"{wire.PREFIX}_open"] is True
    assert by["i", "test::work::End", 0.13]["args"][f"{wire.PREFIX}_orphan_exit"] is True
    plain = by["i", "test::net::Connect", 0.16]
    assert plain["s"] == "t" and plain["args"]["window"] == 4096 and "id" not in plain


def test_rings_that_are_there_once_are_not_compared(spark, tmp_path):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    ring = dump(a, [(1000 + i, PACKET, packet(1, i)) for i in range(40)], ring=Ring(1 << 9))
    dump(b, [(2000, PACKET, packet(1, i)) for i in range(40)], shard=1)
    once, twice = engine.load(spark, str(a), str(b)), engine.load(spark, str(a), str(b), str(a))
    plan = lambda r: r.unique_raw()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(once) and "Aggregate" in plan(twice)
    of = lambda r: sorted((int(x.ts_nanos), x.shard_id, x.phys_offset, bytes(x.fields)) for x in r.records().collect())
    assert of(once) == of(twice) and len({x[:3] for x in of(once)}) == len(of(once)) == 512 // 42 + 40 and ring.head > 512
    assert sorted(map(tuple, once.trace().collect())) == sorted(map(tuple, twice.trace().collect()))


def test_trace_is_read_in_pieces(spark, tmp_path):
    a, out = tmp_path / "a.dump", str(tmp_path / "t.json")
    dump(a, [(1000 + i, PACKET, packet(1, i)) for i in range(200)])
    assert engine.write_trace(engine.load(spark, str(a)), out) == 200
    doc = json.loads((tmp_path / "t.json").read_text())["traceEvents"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = engine.read_trace(spark, out, "struct<ph: string, name: string, ts: double, args: struct<packet_number: bigint>>")
        assert got.rdd.getNumPartitions() > 2
        assert [(r.ph, r.name, r.ts, r.args.packet_number) for r in got.collect()] == [(e["ph"], e["name"], e["ts"], e["args"]["packet_number"]) for e in doc]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    dump(a, [])
    assert engine.write_trace(engine.load(spark, str(a)), out) == 0 and json.loads((tmp_path / "t.json").read_text())["traceEvents"] == []
    assert engine.read_trace(spark, out, "struct<ph: string>").count() == 0


def test_plan_details():
    seq = event("a::tick", Declared("seq", "u64", role="key"), Declared("Event", "u8", role="key"))
    drift = [event("a::one", Declared("x", "u64", role="key")), event("b::two", Declared("x", "i64", role="key"))]
    plan = wide.Plan(Registry.of([seq, *reversed(drift), EventType("z::marker", (), 0)]))
    assert plan.columns == {"x": "x", "seq": "seq_1", "Event": "Event_1"} and plan.promoted["x"] == "unsigned" and plan.structs == {}


def test_odd_widths(spark):
    f = Field("w", "u32", 0, 3)
    row = spark.sql("SELECT unhex('0102030405') AS fields")
    short = Field("s", "u64", 0, 8)
    wide_bool = Field("b", "bool", 0, 1)
    assert tuple(row.select(wide.decoded(f, F.col("fields")), wide.decoded(short, F.col("fields")), wide.decoded(wide_bool, F.col("fields"))).first()) == (None, None, True)
    assert content_id("a::b", "none", [f]) != content_id("a::b", "none", [short])


def test_inspect_and_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "a.dump", tmp_path / "b.dump"
    dump(a, three(), interns=[(1, b"x")], extra=[(wire.VIEWS, b"SELECT 1;\nSELECT 2")])
    dump(b, three(), instance=2)
    text = engine.inspect(spark, str(a))
    for want in ("event types: 5", "test::net::PacketSent: 2", "*conn_id: u64", "$span: u64", "absent at 4294967295", "box, 1 interned texts", "records: 3", "1 sets, 2 lines", "capacity 65536, 3 records"):
        assert want in text
    assert main(["inspect", str(a)], spark) == 0 and "records: 3" in capsys.readouterr().out
    assert main(["merge", str(a), str(b), "-o", str(tmp_path / "m")], spark) == 0
    assert main(["convert", str(tmp_path / "m"), "-o", str(tmp_path / "m.parquet"), "--host", "other"], spark) == 0
    assert engine.footer_of(str(tmp_path / "m.parquet"))[f"{wire.PREFIX}.host"] == "other" and spark.read.parquet(str(tmp_path / "m.parquet")).count() == 6
    assert main(["guide"]) == 0
    with pytest.raises(ValueError):
        engine.output_format("x.txt", None)
    assert engine.output_format(None, "trace") == "trace" and [engine.default_threads(n) for n in (1, 8, 64)] == [1, 2, 4]


def test_files_without_records(spark, tmp_path):
    a = tmp_path / "a.dump"
    a.write_bytes(wire.assemble([(wire.SCHEMA, wire.types_body(TYPES))]))
    recording = engine.load(spark, str(a))
    assert recording.hosts == {0: ""} and recording.events().count() == 0
    (tmp_path / "e").write_bytes(b"")
    with pytest.raises(wire.DumpError):
        engine.load(spark, str(tmp_path / "e")).headers
    out = engine.convert(spark, [str(a)], str(tmp_path / "a.parquet"))
    assert spark.read.parquet(out).count() == 0


def test_types_left_out_at_the_source(spark, tmp_path):
    a = tmp_path / "a.dump"
    dump(a, three())
    assert engine.load(spark, str(a)).raw([CONNECT.id]).count() == 1
