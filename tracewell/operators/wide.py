"""The sparse-wide table: dense columns, promoted keys, and one nullable struct for each event type."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import U64, bytes_text, u64
from tracewell.sources.schema import EventType, Field, Registry
from tracewell.sources.wire import PREFIX

DENSE = tuple("seq ts_nanos event event_id instance_id".split())
_TYPES = {"unsigned": U64, "signed": "bigint", "bool": "boolean", "text": "string"}


def unsigned_bits(bits: Column) -> Column:
    """The unsigned number that a long's bits stand for."""
    wide = bits.cast(U64)
    return F.when(bits < 0, (wide + F.lit(Decimal(1 << 64))).cast(U64)).otherwise(wide)


def slice_of(f: Field, data: Column) -> Column:
    """The field's bytes; null where the record is too short."""
    return F.when(F.octet_length(data) >= f.offset + f.width, F.substring(data, f.offset + 1, f.width))


def _digits(part: Column, width: int) -> Column:
    """Little-endian bytes as hexadecimal digits, highest first.

    Few calls, whatever the width: the code that Spark makes of a wide row must stay small enough to be compiled.
    """
    return F.hex(part) if width == 1 else F.regexp_replace(F.reverse(F.hex(part)), "(.)(.)", "$2$1")


def _raw(part: Column, width: int) -> Column:
    """Little-endian bytes as an unsigned decimal."""
    return F.conv(_digits(part, width), 16, 10).cast(U64)


def decoded(f: Field, data: Column, sentinels: bool = True, text_of: Column | None = None, numeric_enums: bool = False) -> Column:
    """A field of an undecoded record, typed.

    A raw image equal to the sentinel is null (before typing, for any kind up to eight bytes).  A width that
    doesn't fit the kind gives null.  Enum values without a label are shown as numbers; ``text_of`` is the
    interned text already looked up for the field's raw id, missing ones are shown as ``#id``.
    """
    part, out_type = slice_of(f, data), _TYPES[f.output]
    if f.kind == "bytes":
        value = bytes_text(part)
        if sentinels and f.sentinel is not None and f.width in (1, 2, 4, 8):
            value = F.when(_raw(part, f.width) != u64(f.sentinel), value)
        return value
    if f.natural_width is None or f.width != f.natural_width or f.width not in (1, 2, 4, 8):
        return F.lit(None).cast(out_type)
    raw = _digits(part, f.width)
    if sentinels and f.sentinel is not None:
        raw = F.nullif(raw, F.lit(f"{f.sentinel:0{2 * f.width}X}"))
    if f.output == "signed":  # filled up to eight bytes, so that the sign is where a long has it
        return F.shiftright(F.conv(F.concat(raw, F.lit("00" * (8 - f.width))), 16, -10).cast("bigint"), 64 - 8 * f.width)
    if f.output == "bool":
        return raw != F.lit("00" * f.width)
    number = F.conv(raw, 16, 10)
    if f.output == "unsigned":
        return number.cast(U64)
    if f.kind == "enum":
        labels: dict[int, str] = {}
        for value, label in f.labels:
            labels.setdefault(value, label)
        known = F.create_map(*[F.lit(x) for value, label in labels.items() for x in (str(value), label)])
        return F.coalesce(F.element_at(known, number), number) if labels else number
    shown = F.concat(F.lit("#"), number)
    return shown if text_of is None else F.when(raw.isNotNull(), F.coalesce(text_of, shown))


def _metadata(f: Field) -> dict[str, str]:
    out = {f"{PREFIX}.role": f.role} if f.promoted else {}
    for key, value in (("unit", f.unit), ("sentinel", f.sentinel), ("description", f.description)):
        if value is not None:
            out[f"{PREFIX}.{key}"] = str(value)
    return out


@dataclass
class Plan:
    """The columns of the wide table, settled by the registry alone."""

    registry: Registry

    def __post_init__(self) -> None:
        self.types = self.registry.sorted()
        self.names = self.registry.display_names()
        self.promoted: dict[str, str] = {}  # name -> output kind, by first declaration
        for t in self.types:
            for f in t.fields:
                if f.promoted:
                    self.promoted.setdefault(f.name, f.output)
        taken = {c.lower() for c in DENSE}
        self.columns: dict[str, str] = {}  # promoted name -> column: spelled apart where names clash in any case
        for name in self.promoted:
            self.columns[name] = _apart(name, taken)
        self.structs = {t.id: _apart(self.names[t.id], taken) for t in self.types if any(not f.promoted for f in t.fields)}

    def metadata(self, name: str) -> dict[str, str]:
        """That of the first field of the name in any type, promoted or not."""
        return _metadata(next(f for t in self.types for f in t.fields if f.name == name))

    def promoted_columns(self, type_id: Column, value) -> list[Column]:
        """``value(type, field)`` for rows of a type that declares the name; null for others and for drifted kinds."""
        out = []
        for name, kind in self.promoted.items():
            c = F.lit(None).cast(_TYPES[kind])
            for t in reversed(self.types):
                f = next((f for f in t.fields if f.promoted and f.name == name), None)
                if f is not None and f.output == kind:
                    c = F.when(type_id == u64(t.id), value(t, f)).otherwise(c)
            out.append(c.alias(self.columns[name], metadata=self.metadata(name)))
        return out

    def struct_columns(self, type_id: Column, value) -> list[Column]:
        """One struct for each type with fields of its own, null on rows of others; never an empty struct."""
        out = []
        for t in self.types:
            if t.id not in self.structs:
                continue
            taken: set[str] = set()
            children = [value(t, f).alias(_apart(f.name, taken), metadata=_metadata(f)) for f in t.fields if not f.promoted]
            meta = {f"{PREFIX}.span": t.phase} if t.phase != "none" else {}
            if t.description is not None:
                meta[f"{PREFIX}.description"] = t.description
            out.append(F.when(type_id == u64(t.id), F.struct(*children)).alias(self.structs[t.id], metadata=meta))
        return out

    def event_name(self, type_id: Column) -> Column:
        out = F.lit(None).cast("string")
        for t in reversed(self.types):
            out = F.when(type_id == u64(t.id), F.lit(self.names[t.id])).otherwise(out)
        return out

    def keys(self) -> list[tuple[str, str, str]]:
        """(event, field, role) of all promoted fields, types by name, fields as declared."""
        return [(self.names[t.id], f.name, f.role) for t in self.types for f in t.fields if f.promoted]


def _apart(name: str, taken: set[str]) -> str:
    got, n = name, 0
    while got.lower() in taken:
        n += 1
        got = f"{name}_{n}"
    taken.add(got.lower())
    return got


def interned_fields(types: list[EventType]) -> list[tuple[EventType, Field]]:
    return [(t, f) for t in types for f in t.fields if f.kind == "interned" and f.width == 4]


def with_texts(records: DataFrame, types: list[EventType], interns: DataFrame) -> tuple[DataFrame, dict[tuple[int, str], Column]]:
    """Records with the texts of their interned fields, by one left join for all of them.

    ``interns`` is (instance_id, id, text).  The ids a record holds are looked up together: exploded, joined
    and collected again only if a recording has more than one interned field in a type.
    """
    fields = interned_fields(types)
    if not fields:
        return records, {}
    most = max(sum(1 for t, _ in fields if t.id == u.id) for u in types)
    out, places = records, {}
    for k in range(most):
        key = F.lit(None).cast("bigint")
        for t in types:
            own = [f for u, f in fields if u.id == t.id]
            if k < len(own):
                key = F.when(F.col("event_id") == u64(t.id), _raw(slice_of(own[k], F.col("fields")), 4).cast("bigint")).otherwise(key)
                places[t.id, own[k].name] = F.col(f"_text{k}")
        known = interns.select(F.col("instance_id").alias("_i"), F.col("id").alias("_id"), F.col("text").alias(f"_text{k}"))
        out = out.withColumn("_key", key).join(known, (F.col("instance_id") == F.col("_i")) & (F.col("_key") == F.col("_id")), "left").drop("_i", "_id", "_key")
    return out, places


def sparse_wide(records: DataFrame, registry: Registry, interns: DataFrame | None = None) -> DataFrame:
    """The wide table of undecoded records (``seq``, ``ts_nanos``, ``event_id``, ``instance_id``, ``fields``)."""
    plan = Plan(registry)
    texts: dict[tuple[int, str], Column] = {}
    if interns is not None:
        records, texts = with_texts(records, plan.types, interns)
    value = lambda t, f: decoded(f, F.col("fields"), text_of=texts.get((t.id, f.name)))
    kind = F.col("event_id")
    named = records.withColumn("event", plan.event_name(kind))
    return named.select(
        *DENSE, *plan.promoted_columns(kind, value), *plan.struct_columns(kind, value)
    )
