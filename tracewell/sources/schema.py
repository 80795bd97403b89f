"""Event types as a dump describes them: fields, roles, phases, content ids, and the checks on declarations."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import IntEnum

from tracewell.functions.ids import fnv1a64, sentinel_image

INTEGERS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8}
TAGS = {"u8": 0, "u16": 1, "u32": 2, "u64": 3, "i8": 4, "i16": 5, "i32": 6, "i64": 7, "bool": 8, "bytes": 9, "enum": 10, "interned": 11}
ROLES = ("none", "key", "span_id", "parent_span_id")
PHASES = ("none", "enter", "exit")
PROMOTED = ("key", "span_id", "parent_span_id")
MAX_RECORD = 65_535


@dataclass(frozen=True)
class Field:
    """One field of a record: ``kind`` is a key of TAGS; ``detail`` the width of an enum or the flag of an interned field."""

    name: str
    kind: str
    offset: int
    width: int
    role: str = "none"
    description: str | None = None
    unit: str | None = None
    sentinel: int | None = None
    labels: tuple[tuple[int, str], ...] = ()
    detail: int = 0

    @property
    def natural_width(self) -> int | None:
        """Bytes the kind takes, None for plain bytes."""
        return {"bool": 1, "enum": self.detail, "interned": 4, "bytes": None}.get(self.kind, INTEGERS.get(self.kind))

    @property
    def promoted(self) -> bool:
        return self.role in PROMOTED

    @property
    def output(self) -> str:
        """The kind of output column: unsigned, signed, bool or text."""
        if self.kind in INTEGERS:
            return "unsigned" if self.kind[0] == "u" else "signed"
        return "bool" if self.kind == "bool" else "text"


@dataclass(frozen=True)
class EventType:
    name: str
    fields: tuple[Field, ...]
    record_size: int
    phase: str = "none"
    description: str | None = None
    id: int = -1

    def __post_init__(self) -> None:
        if self.id < 0:
            object.__setattr__(self, "id", content_id(self.name, self.phase, self.fields))


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<H", len(raw) & 0xFFFF) + raw


def _optional(value: str | None) -> bytes:
    return b"\0" if value is None else b"\1" + _text(value)


def content_id(name: str, phase: str, fields: Iterable[Field]) -> int:
    """The id of an event type: a hash of all that decoding depends on, so that a changed layout is another type.

    The record size, the id itself and the description of the event take no part; an absent sentinel
    adds nothing at all.
    """
    out = [_text(name), bytes([PHASES.index(phase)])]
    for f in fields:
        out += [_text(f.name), _optional(f.description), bytes([TAGS[f.kind]])]
        if f.kind in ("enum", "interned"):
            out.append(bytes([f.detail]))
        out += [struct.pack("<HHB", f.offset, f.width, ROLES.index(f.role)), _optional(f.unit)]
        if f.sentinel is not None:
            out.append(b"\1" + struct.pack("<Q", f.sentinel))
        for value, label in f.labels:
            out += [struct.pack("<Q", value), _text(label)]
    return fnv1a64(b"".join(out))


# ---- declarations


@dataclass(frozen=True)
class Declared:
    """A field to be laid out by :func:`event`."""

    name: str
    kind: str
    width: int | None = None
    role: str = "none"
    description: str | None = None
    unit: str | None = None
    sentinel: int | None = None
    labels: type[IntEnum] | tuple[tuple[int, str], ...] = ()
    repr: str = "u8"
    dynamic: bool = False


def event(name: str, *fields: Declared, phase: str = "none", description: str | None = None) -> EventType:
    """Lay out and check a declaration; fields follow each other without gaps, as wide as their kinds."""
    if "::" not in name:
        raise ValueError(f"{name}: an event needs a namespace")
    out, offset = [], 0
    for d in fields:
        labels, detail = (), 0
        if d.kind == "enum":
            if d.repr not in ("u8", "u16", "u32", "u64"):
                raise ValueError(f"{d.name}: an enum is represented by u8, u16, u32 or u64")
            labels = tuple((int(x), x.name) for x in d.labels) if isinstance(d.labels, type) else tuple(d.labels)
            detail = INTEGERS[d.repr]
            if any(not 0 <= v < 1 << (8 * detail) for v, _ in labels):
                raise ValueError(f"{d.name}: a value doesn't fit {d.repr}")
        elif d.kind == "interned":
            detail = int(d.dynamic)
        elif d.kind not in TAGS:
            raise ValueError(f"{d.name}: unknown kind {d.kind}")
        f = Field(d.name, d.kind, offset, 0, d.role, d.description, d.unit, None, labels, detail)
        width = f.natural_width if d.kind != "bytes" else d.width
        if width is None:
            raise ValueError(f"{d.name}: bytes need a width")
        if d.role not in ROLES:
            raise ValueError(f"{d.name}: unknown role {d.role}")
        if d.role in ("span_id", "parent_span_id") and d.kind != "u64":
            raise ValueError(f"{d.name}: span ids are u64")
        sentinel = d.sentinel
        if sentinel is not None:
            if d.kind in ("interned", "bool", "bytes"):
                raise ValueError(f"{d.name}: {d.kind} takes no sentinel")
            sentinel = sentinel_image(sentinel, width)
        out.append(replace(f, width=width, sentinel=sentinel))
        offset += width
    for role in ("span_id", "parent_span_id"):
        if sum(f.role == role for f in out) > 1:
            raise ValueError(f"{name}: more than one {role}")
    has_span = any(f.role == "span_id" for f in out)
    if phase not in PHASES or (phase != "none") != has_span:
        raise ValueError(f"{name}: enter and exit events have a span_id, plain ones haven't")
    if offset > MAX_RECORD:
        raise ValueError(f"{name}: {offset} bytes are too many")
    return EventType(name, tuple(out), offset, phase, description)


@dataclass
class Registry:
    """Event types by id, in the order they came; the first of an id stays."""

    types: dict[int, EventType] = field(default_factory=dict)

    @classmethod
    def of(cls, *groups: Iterable[EventType]) -> Registry:
        out = cls()
        for group in groups:
            for t in group:
                out.types.setdefault(t.id, t)
        return out

    def sorted(self) -> list[EventType]:
        """By name; types of one name in the order they came."""
        return sorted(self.types.values(), key=lambda t: t.name)

    def display_names(self) -> dict[int, str]:
        """Names to show: with ``#`` and the id where two types share a name."""
        counts: dict[str, int] = {}
        for t in self.types.values():
            counts[t.name] = counts.get(t.name, 0) + 1
        return {t.id: f"{t.name}#{t.id:016x}" if counts[t.name] > 1 else t.name for t in self.types.values()}
