"""Sets, spans, retention and live recordings on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import retention, sets, spans
from tracewell.plans.stream import epoch_micros
from tracewell.streaming import live

SCHEMA = "ts_nanos long, instance_id long, shard_id long, phys_offset long, payload string, stream_idx int"


def records(rng, n):
    return [(rng.randrange(5), rng.randrange(3), rng.randrange(2), rng.randrange(6), rng.choice("ab"), rng.randrange(3)) for _ in range(n)]


def test_identity_keeps_the_first_stream(spark):
    rows = records(random.Random(1), 300)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in sets.unique(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = {}
    for r in rows:
        want[r[:4]] = min(want.get(r[:4], (9, "z")), (r[5], r[4]))
    assert got == {k: (p, s) for k, (s, p) in want.items()}


def test_numbers_are_dense_and_in_order(spark):
    rows = sorted({r[:4] for r in records(random.Random(2), 400)})
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = sorted((r.seq, (r.ts_nanos, r.instance_id, r.shard_id, r.phys_offset)) for r in sets.numbered(df.repartition(6, "payload", "phys_offset")).collect())
    assert got == list(enumerate(rows))
    assert sorted(r.seq for r in sets.numbered_by_window(df).collect()) == list(range(len(rows)))
    assert sets.numbered(df.limit(0)).count() == 0
    assert [r.ts_nanos for r in sets.ordered(df).collect()] == [r[0] for r in rows]


def test_first_and_last_of_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in sets.first_of(df, ("k",), "at").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in sets.first_of(df, ("k",), "at", last=True).collect()} == {("a", "y"), ("b", "z")}
    with pytest.raises(ValueError):
        sets.union_all()


def test_tree(spark):
    rng = random.Random(3)
    parents = {i: rng.randrange(i) for i in range(1, 120)} | {0: 999, 200: 201, 201: 200}
    for i in range(300, 360):
        parents[i] = i - 1 if i > 300 else None
    df = spark.createDataFrame([(k, *p) for k in (1, 2) for p in parents.items()] + [(3, 0, 5), (3, 5, None), (3, 5, None)], "instance_id long, span_id long, parent_span_id long")
    rows = spans.tree(df).collect()
    assert len(rows) == len({(r.instance_id, r.span_id) for r in rows})
    assert {r.span_id: (r.depth, r.root_id) for r in rows if r.instance_id == 3} == {0: (1, 5), 5: (0, 5)}
    got, other = ({r.span_id: (r.depth, r.root_id) for r in rows if r.instance_id == k} for k in (1, 2))
    assert got == other

    def climb(i):
        depth = 0
        while parents[i] in parents:
            i, depth = parents[i], depth + 1
        return depth, i

    assert got == {i: climb(i) for i in parents if i not in (200, 201)}


def test_span_summary_and_orphans(spark):
    rows = [(1, 5, 10, "enter"), (1, 5, 30, "exit"), (1, 6, 11, "enter"), (2, 5, 12, "exit"), (1, 7, 9, "none"), (1, None, 9, "enter")]
    df = spark.createDataFrame(rows, "instance_id long, span_id long, ts_nanos long, phase string")
    got = {(r.instance_id, r.span_id): (r.status, r.duration_ns) for r in spans.summary(df).collect()}
    assert got == {(1, 5): ("complete", 20), (1, 6): ("open", None), (2, 5): ("orphan_exit", None)}


def test_rings_keep_the_newest_bytes(spark):
    df = spark.createDataFrame([(1, 0, i, 24 if i % 2 else 8) for i in range(30)], "instance_id long, shard_id long, arrival long, size long")
    got = sorted(r.arrival for r in retention.retained(df, 256, F.col("size")).collect())
    held, want = 0, []
    for i in range(29, -1, -1):
        held += (24 if i % 2 else 8) + 18
        if held > 256:
            break
        want.insert(0, i)
    assert got == want


def test_throttle_and_limits():
    assert [retention.throttled_elapsed(x, 1000) for x in (None, 10, 999, 1000, 5000)] == [False, True, True, False, False]
    d = retention.Dumper(10, 3, "keep_oldest")
    assert d.decide([0, 5, 10, 25, 40, 60]) == [True, False, True, True, False, False]
    assert retention.Dumper(0, 3, "keep_newest").decide([1, 2, 3, 4, 5]) == [True] * 5
    # three requests while a dump is written are one, made when it is done
    assert retention.Dumper(0, busy=100).decide([0, 10, 20, 90, 500]) == [True, False, False, True, True]
    # the limit is asked before the throttle: a full recorder doesn't move its clock
    d = retention.Dumper(10, 1, "keep_oldest")
    assert d.decide([0, 20]) == [True, False] and d.last == 0


def test_settings_and_stamps():
    assert retention.settings({}) == {"throttle_ms": 1000, "limit": 8, "policy": "keep_newest", "enabled": True}
    assert retention.settings({"throttle_ms": " 5 ", "limit": "0", "policy": "Keep-Oldest", "enabled": "off"}) == {"throttle_ms": 5, "limit": 0, "policy": "keep_oldest", "enabled": False}
    assert retention.settings({"limit": "many", "policy": "?"})["limit"] == 8
    assert list(retention.stamps([0, 0, 1])) == ["19700101T000000000Z", "19700101T000000000Z-1", "19700101T000000001Z"]


def test_limits_on_tables(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(10)], "instance_id long, ts_nanos long")
    assert sorted(r.ts_nanos for r in retention.keep_oldest(df, 2).collect()) == [0, 1, 2, 3]
    assert sorted(r.ts_nanos for r in retention.keep_newest(df, 2).collect()) == [6, 7, 8, 9]
    assert retention.keep_newest(df, 0).count() == 10
    assert {r.shard for r in df.select(retention.shard_of(F.col("ts_nanos"), 1).alias("shard")).collect()} == {0}


def test_enable_gate(spark):
    df = spark.createDataFrame([(0, t) for t in range(6)], "instance_id long, ts_nanos long")
    switches = spark.createDataFrame([(0, 2, False), (0, 4, True)], "instance_id long, at long, on boolean")
    assert sorted(r.ts_nanos for r in retention.enabled(df, switches).collect()) == [0, 1, 4, 5]


def test_time_is_read_as_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert spark.sql("SELECT timestamp_ntz'1970-01-02 00:00:00.000001' t").select(epoch_micros(F.col("t"))).first()[0] == 86_400_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# ---- live


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_overlapping_snapshots_live(spark, tmp_path):
    rows = sorted({r[:4] for r in records(random.Random(4), 200)})
    for i, part in enumerate((rows[:60], rows[40:120], rows[100:], rows[:10])):
        spark.createDataFrame([(*r, "p", 0) for r in part], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    got = live.arriving(spark, f"{tmp_path}/in/*", SCHEMA, files=1)
    run(live.unique_live(got), "unique_live")
    assert sorted(tuple(r)[:4] for r in spark.table("unique_live").collect()) == rows
    timed = got.withColumn("at", F.timestamp_seconds(F.col("ts_nanos") + 1_000_000_000))
    run(live.unique_live(timed, "1 hour"), "unique_late")
    assert spark.table("unique_late").count() == len(rows)


def test_throttle_live_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    times = {k: sorted(rng.sample(range(1000), 60)) for k in (0, 1)}
    for i in range(3):
        part = [(k, t) for k, v in times.items() for t in v if i * 334 <= t < (i + 1) * 334]
        spark.createDataFrame(part, "instance_id long, ts_nanos long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    # files are taken by time of change: one a batch, oldest first
    got = live.arriving(spark, f"{tmp_path}/in/*", "instance_id long, ts_nanos long", files=1)
    run(live.accepted_live(got, 50), "accepted_live")
    batch = retention.accepted(spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "instance_id long, ts_nanos long"), 50)
    assert {tuple(r) for r in spark.table("accepted_live").collect()} == {tuple(r) for r in batch.collect()}


def test_spans_live(spark, tmp_path):
    schema = "instance_id long, span_id long, ts_nanos long, at timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(s))
    base = spark.range(1).select(F.lit(1).cast("long").alias("instance_id"))
    row = lambda span, s: base.select("instance_id", F.lit(span).cast("long").alias("span_id"), F.lit(s * 10**9).cast("long").alias("ts_nanos"), at(s).alias("at"))
    row(1, 10).union(row(2, 11)).coalesce(1).write.parquet(f"{tmp_path}/en/0")
    row(9, 5000).coalesce(1).write.parquet(f"{tmp_path}/en/1")
    row(1, 20).coalesce(1).write.parquet(f"{tmp_path}/ex/0")
    row(8, 5000).coalesce(1).write.parquet(f"{tmp_path}/ex/1")
    joined = live.spans_live(live.arriving(spark, f"{tmp_path}/en/*", schema, 1), live.arriving(spark, f"{tmp_path}/ex/*", schema, 1), "1 minute", "10 minutes")
    run(joined, "spans_live")
    assert {(r.span_id, r.exit_ts) for r in spark.table("spans_live").collect()} == {(1, 20 * 10**9), (2, None)}


def test_stamps_in_any_zone(spark):
    from tracewell.functions import ids

    times = [0, 1782224730123, 1709164800000, 1729994400000, -1]
    df = spark.createDataFrame([(m,) for m in times], "m long").select("m", ids.stamp(F.col("m")).alias("s"))
    want = {m: ids.utc_stamp(m) for m in times}
    for zone in ("UTC", "Europe/Berlin", "Pacific/Apia"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r.m: r.s for r in df.collect()} == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_fnv_as_column(spark):
    from tracewell.functions import ids

    texts = [b"", b"a", b"foobar", bytes(range(256))]
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "d binary")
    got = {r.d and bytes(r.d): r.h for r in df.select("d", ids.fnv1a64_of(F.col("d")).alias("h")).collect()}
    assert got[None] is None and {k: int(v) for k, v in got.items() if k is not None and k} == {x: ids.fnv1a64(x) for x in texts if x}


def test_statements_are_parted_outside_of_quotes():
    from tracewell.operators import views

    sql = "SELECT ';' AS a; -- one; two\nSELECT `x;y`, \"p;q\" /* ; */ FROM t;; -- end;"
    assert views.split_statements(sql) == ["SELECT ';' AS a", "-- one; two\nSELECT `x;y`, \"p;q\" /* ; */ FROM t"]
    assert views.split_statements("") == [] and views.split_statements("SELECT 'it''s; so'") == ["SELECT 'it''s; so'"]
