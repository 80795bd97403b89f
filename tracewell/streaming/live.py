"""Recordings that keep arriving: files of records, identity across overlapping snapshots, live throttles and spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.sets import IDENTITY
from tracewell.operators.spans import KEY


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 64) -> DataFrame:
    """Parquet files of records as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def unique_live(records: DataFrame, late: str | None = None, at: str = "at") -> DataFrame:
    """Each record once, though successive snapshots of a ring hold it again.

    With ``late``, identities are forgotten that much event time (column ``at``) after, which bounds the state.
    """
    if late is None:
        return records.dropDuplicates(list(IDENTITY))
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark(list(IDENTITY))


def spans_live(enters: DataFrame, exits: DataFrame, late: str, longest: str, at: str = "at") -> DataFrame:
    """Enters with their exits; those without one by ``longest`` come with a null exit."""
    a = enters.select(*KEY, F.col(at).alias("enter_at"), F.col("ts_nanos").alias("enter_ts")).withWatermark("enter_at", late)
    b = exits.select(F.col("instance_id").alias("i"), F.col("span_id").alias("s"), F.col(at).alias("exit_at"), F.col("ts_nanos").alias("exit_ts")).withWatermark("exit_at", late)
    on = (a.instance_id == b.i) & (a.span_id == b.s) & (F.col("exit_at") >= F.col("enter_at")) & (F.col("exit_at") <= F.col("enter_at") + F.expr(f"interval {longest}"))
    return a.join(b, on, "left_outer").select(*KEY, "enter_ts", "exit_ts", "enter_at")


def accepted_live(requests: DataFrame, throttle: int, key: str = "instance_id") -> DataFrame:
    """Dump requests (``key``, ``ts_nanos``) that a throttle lets pass, by a state of one number a recorder.

    Requests of a recorder must arrive in order of time from batch to batch; within one they are sorted.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values("ts_nanos", kind="stable")
        out = []
        for at in rows["ts_nanos"]:
            ok = last is None or at - last >= throttle
            last = at if ok else last
            out.append(bool(ok))
        state.update((int(last),))
        yield pd.DataFrame({key: k[0], "ts_nanos": rows["ts_nanos"].to_numpy(), "accepted": out})

    return (
        requests.select(F.col(key).cast("long").alias(key), "ts_nanos")
        .groupBy(key)
        .applyInPandasWithState(fold, f"{key} long, ts_nanos long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)
    )
