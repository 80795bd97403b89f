"""Extra keys in the footers of Parquet files: only the footer is written anew, all before it stays as it is.

A footer is a struct of Thrift's compact protocol; its fields are found by skipping, and but for the list of
keys their bytes are kept.  So a file of any size takes no more memory than a piece of it and its footer.
"""

from __future__ import annotations

import os
import struct

_MAGIC, _KEYS = b"PAR1", 5
_LIST, _STRUCT = 9, 12


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _unsigned(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _fields(data: bytes, at: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(id, type, start, end) of a struct's fields, and where the struct ends."""
    out, last = [], 0
    while data[at]:
        delta, kind = data[at] >> 4, data[at] & 15
        at += 1
        if delta:
            last += delta
        else:
            n, at = _varint(data, at)
            last = n >> 1 ^ -(n & 1)
        end = at if kind in (1, 2) else _skip(data, at, kind)  # a truth value is its own type
        out.append((last, kind, at, end))
        at = end
    return out, at + 1


def _list(data: bytes, at: int) -> tuple[int, int, int]:
    """(elements, their type, where the first is)."""
    n, kind, at = data[at] >> 4, data[at] & 15, at + 1
    if n == 15:
        n, at = _varint(data, at)
    return n, kind, at


def _skip(data: bytes, at: int, kind: int) -> int:
    if kind in (1, 2, 3):
        return at + 1
    if kind in (4, 5, 6):
        return _varint(data, at)[1]
    if kind == 7:
        return at + 8
    if kind == 8:
        n, at = _varint(data, at)
        return at + n
    if kind in (_LIST, 10):
        n, inner, at = _list(data, at)
        for _ in range(n):
            at = _skip(data, at, inner)
        return at
    if kind == 11:
        n, at = _varint(data, at)
        if n:
            of, at = data[at], at + 1
            for _ in range(n):
                at = _skip(data, _skip(data, at, of >> 4), of & 15)
        return at
    if kind == _STRUCT:
        return _fields(data, at)[1]
    raise ValueError(f"a footer with a value of type {kind}")


def _binary(field: int, text: bytes) -> bytes:
    return bytes([field << 4 | 8]) + _unsigned(len(text)) + text


def with_keys(footer: bytes, keys: dict[str, str]) -> bytes:
    """A file's metadata with ``keys`` added, in place of those of the same names."""
    fields, _ = _fields(footer, 0)
    pairs = []
    for number, _, at, _ in fields:
        if number == _KEYS:
            n, _, at = _list(footer, at)
            for _ in range(n):
                own, end = _fields(footer, at)
                start = next(a for k, _, a, _ in own if k == 1)
                size, start = _varint(footer, start)
                if footer[start : start + size].decode() not in keys:
                    pairs.append(footer[at:end])
                at = end
    pairs += [_binary(1, k.encode()) + _binary(1, v.encode()) + b"\0" for k, v in keys.items()]
    head = bytes([len(pairs) << 4 | _STRUCT]) if len(pairs) < 15 else bytes([0xF0 | _STRUCT]) + _unsigned(len(pairs))
    bodies = {number: (kind, footer[at:end]) for number, kind, at, end in fields} | {_KEYS: (_LIST, head + b"".join(pairs))}
    out, last = [], 0
    for number, (kind, body) in sorted(bodies.items()):
        step = number - last
        out.append(bytes([step << 4 | kind]) if step < 16 else bytes([kind]) + _unsigned(number << 1))
        out.append(body)
        last = number
    return b"".join(out) + b"\0"


def copy_bytes(source, out, length: int, piece: int = 1 << 22) -> None:
    """``length`` bytes from where ``source`` is, a piece at a time."""
    while length:
        data = source.read(min(length, piece))
        if not data:
            raise EOFError("a file is shorter than it said")
        out.write(data)
        length -= len(data)


def copy_with_keys(path: str, out: str, keys: dict[str, str]) -> None:
    with open(path, "rb") as source, open(out, "wb") as target:
        size = source.seek(-8, os.SEEK_END) + 8
        length, magic = struct.unpack("<I4s", source.read(8))
        if magic != _MAGIC:
            raise ValueError(f"{path} isn't a Parquet file with a plain footer")
        source.seek(size - 8 - length)
        footer = with_keys(source.read(length), keys)
        source.seek(0)
        copy_bytes(source, target, size - 8 - length)
        target.write(footer + struct.pack("<I", len(footer)) + _MAGIC)
