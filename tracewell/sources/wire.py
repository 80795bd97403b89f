"""The dump format: an envelope, a table of sections, and their bodies."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

from tracewell.sources.schema import PHASES, ROLES, TAGS, EventType, Field

#: The eight bytes that a file of the format begins with.
MAGIC = bytes.fromhex("4241434b42454154")
#: Prefix of the metadata keys and marks that this engine writes.
PREFIX = "tracewell"
VERSION = 1
SCHEMA, INTERN, SHARD, META, VIEWS = range(5)
_ENVELOPE, _ENTRY = struct.Struct("<8sHHHH"), struct.Struct("<HHQQ")
_NAMES = {tag: name for name, tag in TAGS.items()}


class DumpError(ValueError):
    """A dump that can't be read; ``kind`` says why."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass(frozen=True)
class Section:
    kind: int
    offset: int
    length: int


@dataclass(frozen=True)
class ShardHeader:
    """A shard without its bytes: where they are in the file."""

    instance_id: int
    shard_id: int
    head: int
    capacity: int
    offset: int


class Cursor:
    """Reads little-endian values and fails with a kind, never beyond the end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DumpError("UnexpectedEof")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def text(self) -> str:
        try:
            return self.take(self.number(2)).decode()
        except UnicodeDecodeError as e:
            raise DumpError("InvalidUtf8") from e

    def optional(self) -> str | None:
        return self.text() if self.number(1) else None


def envelope(data: bytes, size: int | None = None) -> tuple[int, list[Section]]:
    """(flags, sections) of a dump of ``size`` bytes whose beginning is ``data``."""
    size = len(data) if size is None else size
    if len(data) < _ENVELOPE.size:
        raise DumpError("UnexpectedEof")
    magic, version, flags, count, _ = _ENVELOPE.unpack_from(data)
    if magic != MAGIC:
        raise DumpError("BadMagic")
    if version != VERSION:
        raise DumpError("UnsupportedVersion", str(version))
    out = []
    for i in range(count):
        at = _ENVELOPE.size + i * _ENTRY.size
        if at + _ENTRY.size > len(data):
            raise DumpError("UnexpectedEof")
        kind, _, offset, length = _ENTRY.unpack_from(data, at)
        if offset + length > size:
            raise DumpError("SectionOutOfBounds", f"section {i}")
        out.append(Section(kind, offset, length))
    return flags, out


def table_bytes(data: bytes) -> int:
    """Bytes from the start that hold envelope and table."""
    if len(data) < _ENVELOPE.size:
        raise DumpError("UnexpectedEof")
    return _ENVELOPE.size + _ENVELOPE.unpack_from(data)[3] * _ENTRY.size


def read_types(body: bytes) -> list[EventType]:
    c, out = Cursor(body), []
    for _ in range(c.number(4)):
        kind, name, description = c.number(8), c.text(), c.optional()
        size, phase, n = c.number(2), c.number(1), c.number(2)
        fields = []
        for _ in range(n):
            fname, fdesc, tag = c.text(), c.optional(), c.number(1)
            if tag not in _NAMES:
                raise DumpError("BadTag", f"type {tag} of {fname}")
            detail = c.number(1) if _NAMES[tag] in ("enum", "interned") else 0
            offset, width, role = c.number(2), c.number(2), c.number(1)
            unit = c.optional()
            sentinel = c.number(8) if c.number(1) else None
            labels = tuple((c.number(8), c.text()) for _ in range(c.number(2)))
            fields.append(Field(fname, _NAMES[tag], offset, width, ROLES[role] if role < len(ROLES) else "none", fdesc, unit, sentinel, labels, detail))
        out.append(EventType(name, tuple(fields), size, PHASES[phase] if phase < len(PHASES) else "none", description, kind))
    return out


def read_interns(body: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    c = Cursor(body)
    instance = c.number(8)
    return instance, [(c.number(4), c.take(c.number(4))) for _ in range(c.number(4))]


def read_meta(body: bytes) -> tuple[int, str]:
    c = Cursor(body)
    return c.number(8), c.text()


SHARD_HEADER = 28


def read_shard_header(body: bytes, section: Section) -> ShardHeader:
    """The header from the first bytes of a shard's body; the region must lie within the section."""
    c = Cursor(body)
    instance, shard, head, capacity = c.number(8), c.number(4), c.number(8), c.number(8)
    if SHARD_HEADER + capacity > section.length:
        raise DumpError("UnexpectedEof", "shard region")
    return ShardHeader(instance, shard, head, capacity, section.offset + SHARD_HEADER)


@dataclass
class Dump:
    """A dump read as a whole: for small files, inspection and tests."""

    data: bytes
    flags: int = 0
    sections: list[Section] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.flags, self.sections = envelope(self.data)

    def bodies(self, kind: int) -> list[bytes]:
        return [self.data[s.offset : s.offset + s.length] for s in self.sections if s.kind == kind]

    def types(self) -> list[EventType]:
        """Those of the first schema section; others don't count."""
        bodies = self.bodies(SCHEMA)
        return read_types(bodies[0]) if bodies else []

    def interns(self) -> list[tuple[int, list[tuple[int, bytes]]]]:
        return [read_interns(b) for b in self.bodies(INTERN)]

    def metas(self) -> list[tuple[int, str]]:
        return [read_meta(b) for b in self.bodies(META)]

    def views(self) -> list[str]:
        try:
            return [b.decode() for b in self.bodies(VIEWS)]
        except UnicodeDecodeError as e:
            raise DumpError("InvalidUtf8") from e

    def shards(self) -> list[tuple[ShardHeader, bytes]]:
        out = []
        for s in self.sections:
            if s.kind == SHARD:
                h = read_shard_header(self.data[s.offset : s.offset + s.length], s)
                out.append((h, self.data[h.offset : h.offset + h.capacity]))
        return out


# ---- writing


def _text(value: str) -> bytes:
    raw = value.encode()
    if len(raw) > 0xFFFF:
        raise ValueError("a name or label is too long")
    return struct.pack("<H", len(raw)) + raw


def _optional(value: str | None) -> bytes:
    return b"\0" if value is None else b"\1" + _text(value)


def types_body(types: Iterable[EventType]) -> bytes:
    types = list(types)
    out = [struct.pack("<I", len(types))]
    for t in types:
        out += [struct.pack("<Q", t.id), _text(t.name), _optional(t.description), struct.pack("<HBH", t.record_size, PHASES.index(t.phase), len(t.fields))]
        for f in t.fields:
            out += [_text(f.name), _optional(f.description), bytes([TAGS[f.kind]])]
            if f.kind in ("enum", "interned"):
                out.append(bytes([f.detail]))
            out += [struct.pack("<HHB", f.offset, f.width, ROLES.index(f.role)), _optional(f.unit)]
            out.append(b"\0" if f.sentinel is None else b"\1" + struct.pack("<Q", f.sentinel))
            out.append(struct.pack("<H", len(f.labels)))
            out += [struct.pack("<Q", v) + _text(label) for v, label in f.labels]
    return b"".join(out)


def intern_body(instance_id: int, entries: Iterable[tuple[int, bytes]]) -> bytes:
    entries = list(entries)
    return struct.pack("<QI", instance_id, len(entries)) + b"".join(struct.pack("<II", i, len(b)) + b for i, b in entries)


def meta_body(instance_id: int, host: str) -> bytes:
    return struct.pack("<Q", instance_id) + _text(host)


def shard_header(instance_id: int, shard_id: int, head: int, capacity: int) -> bytes:
    return struct.pack("<QIQQ", instance_id, shard_id, head, capacity)


def shard_body(instance_id: int, shard_id: int, head: int, region: bytes) -> bytes:
    return shard_header(instance_id, shard_id, head, len(region)) + region


def layout(sizes: list[tuple[int, int]]) -> bytes:
    """Envelope and table for sections of (kind, bytes) that follow in this order."""
    if len(sizes) > 0xFFFF:
        raise ValueError("more than 65,535 sections; merge shards first")
    at = _ENVELOPE.size + _ENTRY.size * len(sizes)
    out = [_ENVELOPE.pack(MAGIC, VERSION, 1, len(sizes), 0)]
    for kind, size in sizes:
        out.append(_ENTRY.pack(kind, 0, at, size))
        at += size
    return b"".join(out)


def assemble(sections: list[tuple[int, bytes]]) -> bytes:
    """A whole dump of sections of (kind, body)."""
    return layout([(k, len(b)) for k, b in sections]) + b"".join(b for _, b in sections)
