"""Ring regions: recovering records newest first, writing them, and repacking survivors."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa

from tracewell.functions.ids import next_pow2

SUFFIX = 2
PREFIX = 16
#: Physical offset given to the one record that lies across the end of a ring.
WRAPPED = 0xFFFF_FFFF
_HEAD = struct.Struct("<QQ")


def walk(region: bytes, head: int, capacity: int, sizes: Mapping[int, int]) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_nanos, event id, physical offset, fields) of each record, newest first.

    A candidate counts if its length leads to a registered event id whose record size fits; anything
    else (a record still being written, overwritten bytes) moves the reader back by one byte, so that
    damage costs only the records it hit.
    """
    if len(region) == capacity:
        yield from walk_pieces(lambda begin, n: region[begin : begin + n], head, capacity, sizes, capacity)


def walk_pieces(read: Callable[[int, int], bytes], head: int, capacity: int, sizes: Mapping[int, int], piece: int = 1 << 22) -> Iterator[tuple[int, int, int, bytes]]:
    """:func:`walk` over a region that stays where it is: ``read(begin, n)`` gives bytes of it, one piece is held at a time."""
    if capacity <= 0 or capacity & (capacity - 1):
        return
    mask, low = capacity - 1, max(0, head - capacity)
    lengths = {size + PREFIX for size in sizes.values()}
    reach = max(lengths, default=0) + SUFFIX
    at = base = head
    block = b""  # the bytes from base, counted from the first byte ever written
    while at >= low + SUFFIX:
        if at - reach < base and base > low:
            base = max(low, at - max(piece, reach))
            begin, n = base & mask, at - base
            block = read(begin, min(n, capacity - begin))
            if begin + n > capacity:
                block += read(0, begin + n - capacity)
        end = at - base - SUFFIX
        length = block[end] | block[end + 1] << 8
        start = at - SUFFIX - length
        if length in lengths and start >= low:
            ts, kind = _HEAD.unpack_from(block, end - length)
            if sizes.get(kind) == length - PREFIX:
                begin = start & mask
                yield ts, kind, begin if begin + length <= capacity else WRAPPED, block[end - length + PREFIX : end]
                at = start
                continue
        at -= 1


class Ring:
    """A ring of bytes that the newest records win."""

    def __init__(self, capacity: int) -> None:
        self.capacity = next_pow2(capacity)
        self.region = bytearray(self.capacity)
        self.head = 0

    def push(self, ts_nanos: int, event_id: int, fields: bytes) -> int:
        """Write one record; its start, counted from the first byte ever written."""
        payload = _HEAD.pack(ts_nanos, event_id) + fields
        if len(payload) > 0xFFFF or len(payload) + SUFFIX > self.capacity:
            raise ValueError("record is larger than the format or the ring allows")
        record = payload + struct.pack("<H", len(payload))
        start, begin = self.head, self.head & (self.capacity - 1)
        first = min(self.capacity - begin, len(record))
        self.region[begin : begin + first] = record[:first]
        self.region[: len(record) - first] = record[first:]
        self.head += len(record)
        return start


def repacked(records: Iterable[tuple[int, int, bytes]]) -> tuple[bytes, int]:
    """(region, head) of records given oldest first: no larger than it must be, none across the end."""
    parts = []
    for ts, kind, fields in records:
        payload = _HEAD.pack(ts, kind) + fields
        parts.append(payload + struct.pack("<H", len(payload)))
    body = b"".join(parts)
    return body.ljust(next_pow2(len(body)), b"\0"), len(body)


def packed(ts_bits: np.ndarray, type_bits: np.ndarray, fields: pa.Array) -> bytes:
    """The bytes of records given oldest first, as :func:`repacked` joins them; whole columns at once."""
    fields = fields.cast(pa.binary())
    if fields.null_count:
        raise ValueError("a record has no fields")
    _, places, data = fields.buffers()
    places = np.frombuffer(places, np.int32, len(fields) + 1, 4 * fields.offset).astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    sizes = np.diff(places)
    if len(sizes) and sizes.max() + PREFIX > 0xFFFF:
        raise ValueError("record is larger than the format allows")
    ends = np.cumsum(sizes + PREFIX + SUFFIX)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    heads = np.stack([ts_bits, type_bits], axis=1).astype("<i8").view(np.uint8)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        record = np.empty((len(rows), size + PREFIX + SUFFIX), np.uint8)
        record[:, :PREFIX] = heads[rows]
        record[:, PREFIX:-SUFFIX] = data[places[rows][:, None] + np.arange(size)]
        record[:, -SUFFIX:] = np.frombuffer(struct.pack("<H", size + PREFIX), np.uint8)
        out[(ends[rows] - record.shape[1])[:, None] + np.arange(record.shape[1])] = record
    return out.tobytes()
