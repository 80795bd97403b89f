"""Identifiers and stamps: FNV-1a, content ids, span ids, hexadecimal and UTC renderings."""

from __future__ import annotations

from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Type of unsigned 64-bit columns.
U64 = "decimal(20,0)"


def fnv1a64(data: bytes, state: int = _OFFSET) -> int:
    """FNV-1a over bytes, continued from ``state``."""
    for b in data:
        state = ((state ^ b) * _PRIME) & MASK64
    return state


def mix64(x: int) -> int:
    """The finaliser of splitmix64; spreads counters over all bits."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK64
    return x ^ (x >> 31)


def next_pow2(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def compose_span_id(counter: int, seed: int) -> int:
    return ((counter << 16) | (seed & 0xFFFF)) & MASK64


def sentinel_image(value: int, width: int) -> int:
    """A sentinel as the zero-extended bytes of a field of this width (-1 in four bytes is 0xFFFFFFFF)."""
    return value & ((1 << (8 * width)) - 1)


def utc_stamp(millis: int, previous: str = "") -> str:
    """``YYYYMMDDThhmmssSSSZ``; with ``-N`` if that is the previous stamp without its own number."""
    base = datetime.fromtimestamp(millis // 1000, UTC).strftime("%Y%m%dT%H%M%S") + f"{millis % 1000:03d}Z"
    stem, _, n = previous.partition("-")
    return f"{base}-{int(n or 0) + 1}" if stem == base else base


# ---- columns


def u64(value: int) -> Column:
    """A literal of an unsigned 64-bit value."""
    return F.lit(Decimal(value)).cast(U64)


def signed_image(c: Column) -> Column:
    """An order-preserving long for an unsigned decimal: half the bytes to shuffle and compare."""
    return (c - F.lit(Decimal(1 << 63))).cast("long")


def hex16(c: Column) -> Column:
    """Sixteen hexadecimal digits of an unsigned 64-bit value, lower case."""
    return F.lpad(F.lower(F.conv(c.cast("string"), 10, 16)), 16, "0")


def id_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), hex16(c))


def bytes_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def category(name: Column) -> Column:
    """What comes before the first ``::`` of a qualified name."""
    return F.substring_index(name, "::", 1)


def micros(ts_nanos: Column) -> Column:
    """Nanoseconds as microseconds in floating point, as trace viewers take them."""
    return ts_nanos.cast("double") / F.lit(1000.0)


def stamp(millis: Column) -> Column:
    """:func:`utc_stamp` of a column, without numbers for equal ones, in UTC whatever the session's zone is."""
    # a day and a time of day by arithmetic: a zone with gaps in its clock has no image of every UTC time
    day, rest = F.floor(millis / F.lit(86_400_000)), F.pmod(millis, F.lit(86_400_000))
    part = lambda unit, turn, width: F.lpad((F.floor(rest / F.lit(unit)) % F.lit(turn)).cast("string"), width, "0")
    date = F.date_format(F.date_from_unix_date(day.cast("int")), "yyyyMMdd")
    return F.concat(date, F.lit("T"), part(3_600_000, 24, 2), part(60_000, 60, 2), part(1000, 60, 2), part(1, 1000, 3), F.lit("Z"))


def fnv1a64_of(data: Column) -> Column:
    """:func:`fnv1a64` of a binary column, as an unsigned 64-bit value.

    The state is two halves of 32 bits, as products of whole 64-bit values overflow; the prime is 2^40 + 435.
    """
    low32 = F.lit(0xFFFFFFFF)
    begin = F.struct(F.lit(_OFFSET >> 32).cast("long").alias("hi"), F.lit(_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))

    def step(state: Column, at: Column) -> Column:
        lo = state["lo"].bitwiseXOR(F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long"))
        product = lo * F.lit(435)
        hi = state["hi"] * F.lit(435) + F.shiftright(product, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    whole = lambda s: s["hi"].cast(U64) * F.lit(Decimal(1 << 32)) + s["lo"].cast(U64)
    return F.when(data.isNotNull(), F.aggregate(places, begin, step, whole).cast(U64))


def span_counter(span_id: Column) -> Column:
    return F.floor(span_id / F.lit(1 << 16)).cast(U64)


def span_seed(span_id: Column) -> Column:
    return (span_id % F.lit(1 << 16)).cast("int")


def pow2_ceiling(n: Column) -> Column:
    """The next power of two, exactly: by doubling bits, not by floating-point logarithms."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.length(F.bin(n - 1)))).cast("long")
