"""Helpers shared by the corpus operators: shared storage, column names, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides up to this many bytes may be broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` or the context's checkpoint folder is used where set.  A folder of this
    machine is made only in plain local mode, where driver and executors are one process.
    """
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir
    context = spark.sparkContext
    if (current := context._jsc.sc().getCheckpointDir()).isDefined():
        return current.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose rows have gone into later ones; other tables are left as they are."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if "/tracewell/" in folder:
                delete(table.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with a numeric suffix where a column (in any case) has it already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        got, n = name, 0
        while got.lower() in taken:
            n += 1
            got = f"{name}_{n}"
        taken.add(got.lower())
        out.append(got)
    return out


def quoted(name: str) -> Column:
    """A top-level column whatever signs its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame) -> list[Column]:
    """All columns as xxhash64 takes them: those with maps or variants in them by their JSON."""

    def ok(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ok(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ok(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [quoted(f.name) if ok(f.dataType) else F.to_json(F.struct(quoted(f.name).alias("c"))) for f in df.schema.fields]


def row_bytes(df: DataFrame) -> Column:
    """Rough bytes of a row in memory: strings by length, the rest by a flat allowance."""
    total = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            total = total + F.greatest(F.size(quoted(f.name)), F.lit(0)) * 16 + 8
        else:
            total = total + 8
    return total.cast("long")


def total_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and rough bytes of the whole table, by one narrow aggregate."""
    rows, size = df.select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return int(rows), int(size)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table is measured to fit under ``limit`` bytes."""
    return total_bytes(df)[1] <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only for a measured size; beyond it the join shuffles."""
    return F.broadcast(df) if small(df, limit) else df
