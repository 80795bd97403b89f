"""The ``events`` table seen as a recorded stream: one ring record for each row."""

from __future__ import annotations

import tempfile
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.schema import Declared, EventType, Registry, event

TYPES = ("click", "error", "purchase", "signup", "view")
RECORD_BYTES = 50

#: The same mapping as SQL; queries are stated over it.
SQL = (
    "SELECT event_id AS row_id, epoch_us(ts) * 1000 AS ts_nanos, user_id % 3 AS instance_id, user_id % 4 AS shard_id, "
    "event_id * 50 AS phys_offset, 'app::' || event_type AS event, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS value_cents, props FROM events"
)


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone read as UTC, whatever the session's zone is."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select(
        F.col("event_id").alias("row_id"),
        (epoch_micros(F.col("ts")) * 1000).alias("ts_nanos"),
        (F.col("user_id") % 3).alias("instance_id"),
        (F.col("user_id") % 4).alias("shard_id"),
        (F.col("event_id") * RECORD_BYTES).alias("phys_offset"),
        F.concat(F.lit("app::"), "event_type").alias("event"),
        "event_type",
        "user_id",
        F.round(F.col("value") * 100).cast("bigint").alias("value_cents"),
        "props",
    )


def event_type(name: str) -> EventType:
    """How a row of one kind is recorded."""
    return event(
        f"app::{name}",
        Declared("row_id", "u64", role="key"),
        Declared("user_id", "u64", role="key"),
        Declared("value_cents", "i64", unit="cents"),
        Declared("props", "interned", dynamic=True),
        Declared("_pad", "bytes", width=4),
    )


def registry() -> Registry:
    return Registry.of([event_type(t) for t in TYPES])


def scratch(spark: SparkSession) -> str:
    """A folder for files, shared as the session says; one of this machine only in plain local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        parsed = urlparse(named)
        if parsed.scheme in ("", "file"):
            return parsed.path
        raise ValueError("dumps are written to a folder that is mounted on all machines")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracewell-")
