"""Spans: pairs of enter and exit records, halves without the other, trees, and trace events.

Inputs have ``instance_id``, ``span_id``, ``ts_nanos`` and ``phase`` (none, enter or exit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.ids import category, id_text, micros
from tracewell.functions.storage import kept
from tracewell.sources.wire import PREFIX

KEY = ["instance_id", "span_id"]
#: Arguments that mark the events that were made up.
OPEN, ORPHAN = f"{PREFIX}_open", f"{PREFIX}_orphan_exit"


def pairs(enters: DataFrame, exits: DataFrame) -> DataFrame:
    """(instance_id, span_id, enter_ts, exit_ts, duration_ns) for each enter with each exit of its id."""
    a = enters.select(*KEY, F.col("ts_nanos").alias("enter_ts"))
    b = exits.select(*KEY, F.col("ts_nanos").alias("exit_ts"))
    return a.join(b, KEY).withColumn("duration_ns", F.col("exit_ts") - F.col("enter_ts"))


def orphan_enters(enters: DataFrame, exits: DataFrame) -> DataFrame:
    return enters.join(exits.select(*KEY), KEY, "left_anti")


def orphan_exits(enters: DataFrame, exits: DataFrame) -> DataFrame:
    return exits.join(enters.select(*KEY), KEY, "left_anti")


def paired(records: DataFrame, others: DataFrame) -> DataFrame:
    """Records whose span the other side has too, whatever the times and however often."""
    return records.join(others.select(*KEY), KEY, "left_semi")


def summary(records: DataFrame) -> DataFrame:
    """One row a span: first enter, first exit, and whether it is complete, open or orphaned.

    One aggregate over a single shuffle on the span's key, where joining both sides takes two.
    """
    at = lambda phase: F.min(F.when(F.col("phase") == phase, F.col("ts_nanos")))
    return (
        records.where("phase != 'none' and span_id is not null")
        .groupBy(*KEY)
        .agg(at("enter").alias("enter_ts"), at("exit").alias("exit_ts"))
        .withColumn("status", F.when(F.col("exit_ts").isNull(), "open").when(F.col("enter_ts").isNull(), "orphan_exit").otherwise("complete"))
        .withColumn("duration_ns", F.col("exit_ts") - F.col("enter_ts"))
    )


def tree(spans: DataFrame, root_depth: int = 0) -> DataFrame:
    """(instance_id, span_id, parent_span_id, depth, root_id) for the first three: spans whose parent isn't there are roots.

    A parent is looked for in its child's instance, as span ids are only unique there.  A span recorded more
    than once is one span of each parent it names.  Pointer doubling: each round every span's ancestor
    becomes its ancestor's ancestor, so a chain of n takes log2(n) joins, not n; it ends when a round moves
    nothing.  Spans on a cycle belong to no root and are left out.
    """
    spans = spans.select(*KEY, "parent_span_id").distinct()
    ids = spans.select("instance_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known")).distinct()
    at = spans.join(ids, ["instance_id", "parent_span_id"], "left").select(
        *KEY, "parent_span_id", F.when(F.col("known"), F.col("parent_span_id")).otherwise(F.col("span_id")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps")
    )
    at, climbing, most = kept(at), True, spans.count()
    reach = 1
    while climbing and reach < 2 * most:  # on a cycle there is no end to climbing, but no path is longer than all spans
        above = at.select("instance_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more")).distinct()
        at = kept(
            at.join(above, ["instance_id", "up"]).select(*KEY, "parent_span_id", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")).distinct()
        )
        climbing = not at.where("moved").isEmpty()
        reach *= 2
    roots = at.where("steps = 0").select("instance_id", F.col("span_id").alias("up")).distinct()
    return at.join(roots, ["instance_id", "up"]).select(*KEY, "parent_span_id", (F.col("steps") + root_depth).cast("int").alias("depth"), F.col("up").alias("root_id"))


def trace_events(records: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Rows of (ph, name, cat, id, pid, tid, ts, ts_nanos, mark, args) as trace viewers take them.

    ``records`` also have ``name``, ``shard_id`` and ``args`` (JSON text or null).  An enter with an exit
    is a ``b``, one without a ``b`` and an ``e`` at the last time of the whole recording; an exit with an
    enter is an ``e``, one without an instant; all else is an instant.  ``mark`` names what was made up.
    Whether a span has its other half comes from one window over its key, the last time from one aggregate (of
    ``times``, if they are to be had for less than ``records``).
    """
    in_span = F.coalesce((F.col("phase") != "none") & F.col("span_id").isNotNull(), F.lit(False))
    # one pass for all: rows outside of spans are spread by their place, and each is looked at alone or nearly so
    spread = F.when(~F.col("_in"), F.xxhash64("ts_nanos", "shard_id", "name"))
    w = Window.partitionBy("instance_id", F.when(F.col("_in"), F.col("span_id")), spread)
    has = lambda phase: F.coalesce(F.max(F.when(F.col("phase") == phase, True)).over(w), F.lit(False))
    rows = records.withColumn("_in", in_span).withColumn("_enter", has("enter")).withColumn("_exit", has("exit"))
    rows = rows.withColumn("other", F.when(F.col("_in"), F.when(F.col("phase") == "enter", F.col("_exit")).otherwise(F.col("_enter"))))
    last = (records if times is None else times).agg(F.coalesce(F.max("ts_nanos"), F.lit(0)).alias("last_ts"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    shown = lambda ph, ts, mark: F.struct(F.lit(ph).alias("ph"), ts.alias("at"), F.lit(mark).alias("mark"))
    own, none = F.col("ts_nanos"), None
    kinds = (
        F.when(F.col("other").isNull(), F.array(shown("i", own, none)))
        .when((F.col("phase") == "enter") & F.col("other"), F.array(shown("b", own, none)))
        .when(F.col("phase") == "enter", F.array(shown("b", own, none), shown("e", F.col("last_ts").cast(records.schema["ts_nanos"].dataType), "open")))
        .when(F.col("other"), F.array(shown("e", own, none)))
        .otherwise(F.array(shown("i", own, "orphan_exit")))
    )
    out = rows.withColumn("k", F.explode(kinds))
    return out.select(
        F.col("k.ph").alias("ph"),
        "name",
        category(F.col("name")).alias("cat"),
        F.when(F.col("k.ph") != "i", id_text(F.col("span_id"))).alias("id"),
        F.col("instance_id").alias("pid"),
        F.col("shard_id").alias("tid"),
        micros(F.col("k.at")).alias("ts"),
        F.col("k.at").alias("ts_nanos"),
        F.col("k.mark").alias("mark"),
        *[c for c in ("args",) if c in records.columns],
    )


def trace_json(events: DataFrame) -> DataFrame:
    """One JSON text a trace event (column ``value``); ``args`` are spliced in with the mark."""
    args = F.coalesce(F.col("args"), F.lit("{}")) if "args" in events.columns else F.lit("{}")
    flag = F.concat(F.lit(f'"{PREFIX}_'), F.col("mark"), F.lit('":true'))
    body = F.expr("substring(_a, 2, length(_a) - 2)")
    marked = F.when(F.col("mark").isNull(), F.col("_a")).when(F.col("_a") == "{}", F.concat(F.lit("{"), flag, F.lit("}"))).otherwise(F.concat(F.lit("{"), body, F.lit(","), flag, F.lit("}")))
    head = F.to_json(F.struct("ph", "name", "cat", "id", "pid", "tid", "ts", F.when(F.col("ph") == "i", "t").alias("s")))
    rows = events.withColumn("_a", args).withColumn("_m", marked).withColumn("_h", head)
    return rows.select("pid", "tid", "ts_nanos", F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"args":'), F.col("_m"), F.lit("}")).alias("value"))
