"""Views over the wide table: one an event type, the manifest of keys, and registered SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.ids import u64
from tracewell.operators.wide import Plan
from tracewell.sources.schema import Registry
from tracewell.sources.wire import PREFIX

MANIFEST = f"{PREFIX}_keys"


def quote(name: str) -> str:
    """An identifier for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def quote_double(name: str) -> str:
    """An identifier for engines that quote by ``"``."""
    return '"' + name.replace('"', '""') + '"'


def quote_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def event_view(events: DataFrame, type_id: int) -> DataFrame:
    """The rows of one event type, all columns: a filter that reaches the Parquet scan."""
    return events.where(F.col("event_id") == u64(type_id))


def manifest(spark: SparkSession, registry: Registry) -> DataFrame:
    """(event, field, role) of all promoted fields; no rows, but typed, if there are none."""
    return spark.createDataFrame(Plan(registry).keys(), "event string, field string, role string")


def register(events: DataFrame, registry: Registry) -> list[str]:
    """Make ``events``, a view an event type and the manifest temporary views; their names."""
    spark = events.sparkSession
    events.createOrReplaceTempView("events")
    plan = Plan(registry)
    for t in plan.types:
        event_view(events, t.id).createOrReplaceTempView(quote(plan.names[t.id]))
    manifest(spark, registry).createOrReplaceTempView(MANIFEST)
    return ["events", *[plan.names[t.id] for t in plan.types], MANIFEST]


def ddl(registry: Registry, registered: list[str] = (), bind: str | None = None, dialect: str = "duckdb") -> str:
    """The views as SQL text, then the registered statements as they are, which are never run by themselves.

    ``bind`` is the Parquet file that ``events`` is to read.
    """
    plan = Plan(registry)
    q = quote_double if dialect == "duckdb" else quote
    create = "CREATE OR REPLACE VIEW" if dialect == "duckdb" else "CREATE OR REPLACE TEMPORARY VIEW"
    out = []
    if bind is not None:
        scan = f"read_parquet({quote_text(bind)})" if dialect == "duckdb" else f"parquet.{quote(bind)}"
        out.append(f"{create} events AS SELECT * FROM {scan};")
    out += [f"{create} {q(plan.names[t.id])} AS SELECT * FROM events WHERE event_id = {t.id};" for t in plan.types]
    keys = plan.keys()
    if keys:
        values = ",\n".join(f"  ({quote_text(e)}, {quote_text(f)}, {quote_text(r)})" for e, f, r in keys)
        out.append(f"{create} {MANIFEST} AS SELECT * FROM (VALUES\n{values}\n) AS t(event, field, role);")
    else:
        text = "CAST(NULL AS VARCHAR)" if dialect == "duckdb" else "CAST(NULL AS STRING)"
        out.append(f"{create} {MANIFEST} AS SELECT {text} AS event, {text} AS field, {text} AS role WHERE false;")
    for i, sql in enumerate(registered, 1):
        out.append(f"-- Registered statements {i}\n{sql.rstrip(chr(10))}")
    return "\n".join(out) + "\n"


#: What a semicolon inside of ends no statement: quoted texts and names, comments.
_OPAQUE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.DOTALL)


def split_statements(sql: str) -> list[str]:
    """The statements of a text, parted by semicolons outside of quotes and comments; those of comments alone are left out."""
    out: list[str] = []
    text, has = "", False
    for part in [*_OPAQUE.findall(sql), ";"]:
        if part == ";":
            if has:
                out.append(text.strip())
            text, has = "", False
        else:
            text += part
            has = has or bool(part.strip()) and not part.startswith(("--", "/*"))
    return out


def apply_registered(spark: SparkSession, statements: list[str]) -> None:
    """Run registered statements, in Spark's dialect.  They come from whoever wrote the dump: only on request."""
    for sql in statements:
        for one in split_statements(sql):
            spark.sql(one)


def table_function(spark: SparkSession, name: str, arguments: str, query: str) -> None:
    """A parameterised view: ``SELECT * FROM name(...)``."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quote(name)}({arguments}) RETURNS TABLE RETURN {query}")


def functions(spark: SparkSession, like: str) -> list[str]:
    """Names of the functions that match a pattern of SHOW FUNCTIONS."""
    return [r[0] for r in spark.sql(f"SHOW USER FUNCTIONS LIKE {quote_text(like)}").collect()]
