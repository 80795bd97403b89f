"""Which records and dumps survive: rings that keep the newest bytes, limits and throttles on dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shard_of(cpu: Column, shards: int) -> Column:
    """The ring a CPU writes to."""
    return F.lit(0) if shards <= 1 else F.pmod(cpu, F.lit(shards))


def retained(records: DataFrame, capacity: int, size: Column, arrival: str = "arrival", ring: tuple[str, ...] = ("instance_id", "shard_id")) -> DataFrame:
    """The records that rings of ``capacity`` bytes still hold: the newest whose bytes, with 18 each, fit."""
    w = Window.partitionBy(*ring).orderBy(F.col(arrival).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("_held", F.sum(size + F.lit(18)).over(w)).where(F.col("_held") <= capacity).drop("_held")


def enabled(records: DataFrame, switches: DataFrame, key: str = "instance_id") -> DataFrame:
    """The records made while recording was on: the last switch (``at``, ``on``) before each says so; on at first."""
    a = records.withColumn("_kind", F.lit(1)).withColumn("_at", F.col("ts_nanos")).withColumn("_on", F.lit(None).cast("boolean"))
    b = switches.select(F.col(key), F.col("at").alias("_at"), F.col("on").alias("_on"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b, allowMissingColumns=True).withColumn("_now", F.coalesce(F.last("_on", True).over(w), F.lit(True))).where("_kind = 1 and _now").drop("_kind", "_at", "_on", "_now")


def keep_oldest(dumps: DataFrame, limit: int, key: tuple[str, ...] = ("instance_id",), at: tuple[str, ...] = ("ts_nanos",)) -> DataFrame:
    """The first ``limit`` dumps of a recorder; 0 is no limit."""
    return dumps if not limit else _ranked(dumps, limit, key, [F.col(c).asc() for c in at])


def keep_newest(dumps: DataFrame, limit: int, key: tuple[str, ...] = ("instance_id",), at: tuple[str, ...] = ("ts_nanos",)) -> DataFrame:
    """The last ``limit`` dumps of a recorder; 0 is no limit."""
    return dumps if not limit else _ranked(dumps, limit, key, [F.col(c).desc() for c in at])


def _ranked(dumps: DataFrame, limit: int, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    return dumps.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


class Dumper:
    """The decisions of one recorder, request by request: the limit first, then the throttle.

    A request while a dump is being written (``busy`` nanoseconds long) only sets a flag: all such requests
    together are one, seen when the dump is done.
    """

    def __init__(self, throttle: int, limit: int = 0, policy: str = "keep_newest", busy: int = 0) -> None:
        self.throttle, self.limit, self.policy, self.busy = throttle, limit, policy, busy
        self.last: int | None = None
        self.live = 0

    def accepts(self, at: int) -> bool:
        full = bool(self.limit) and self.live >= self.limit
        if full and self.policy == "keep_oldest":
            return False
        if self.last is not None and at - self.last < self.throttle:
            return False
        self.last = at + self.busy
        self.live = self.live if full else self.live + 1
        return True

    def decide(self, times: list[int]) -> list[bool]:
        """For sorted requests, which lead to a dump."""
        out: list[bool] = []
        pending = None
        for i, at in enumerate(times):
            if self.last is not None and self.busy and at < self.last and self._running(at):
                pending = i
                out.append(False)
                continue
            if pending is not None:
                out[pending] = self.accepts(self.last)
                pending = None
            out.append(self.accepts(at))
        if pending is not None:
            out[pending] = self.accepts(self.last)
        return out

    def _running(self, at: int) -> bool:
        return self.last - self.busy <= at


def accepted(requests: DataFrame, throttle: int, limit: int = 0, policy: str = "keep_newest", busy: int = 0, key: str = "instance_id", at: str = "ts_nanos") -> DataFrame:
    """``requests`` with ``accepted``; each decision depends on the one before, so a recorder's are folded in order.

    Requests are grouped by recorder; one recorder's requests (not its records) must fit in a task.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("accepted", T.BooleanType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        return pdf.assign(accepted=Dumper(throttle, limit, policy, busy).decide([int(x) for x in pdf[at]]))

    return requests.groupBy(key).applyInPandas(fold, schema)


def throttled_elapsed(elapsed: int | None, throttle: int) -> bool:
    """Whether a request so long after the last dump is dropped; the first never is."""
    return elapsed is not None and elapsed < throttle


def settings(environment: dict[str, str]) -> dict[str, object]:
    """Throttle, limit and policy of a dumper from texts, with the defaults of 1000 ms, 8 and keep_newest."""
    out: dict[str, object] = {"throttle_ms": 1000, "limit": 8, "policy": "keep_newest", "enabled": True}
    for name, value in environment.items():
        text = value.strip().lower()
        if name in ("throttle_ms", "limit") and text.isdigit():
            out[name] = int(text)
        elif name == "policy" and text.replace("-", "_") in ("keep_oldest", "keep_newest"):
            out[name] = text.replace("-", "_")
        elif name == "enabled":
            out[name] = text in ("1", "true", "yes", "on")
    return out


def stamps(millis: list[int]) -> Iterator[str]:
    """Stamps of dumps in order; equal ones get numbers."""
    from tracewell.functions.ids import utc_stamp

    last = ""
    for m in millis:
        last = utc_stamp(m, last)
        yield last
