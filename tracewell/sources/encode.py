"""Rows as record fields: the reverse of decoding, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.sources.schema import INTEGERS, EventType

_CODES = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "i8": "<i1", "i16": "<i2", "i32": "<i4", "i64": "<i8"}


def dtype_of(event: EventType) -> np.dtype:
    """The layout of a type's fields; padding is of plain bytes."""
    code = lambda f: _CODES.get(f.kind) or {"bool": "u1", "interned": "<u4", "bytes": f"V{f.width}"}.get(f.kind) or f"<u{f.detail}"
    return np.dtype({"names": [f.name for f in event.fields], "formats": [code(f) for f in event.fields], "offsets": [f.offset for f in event.fields], "itemsize": event.record_size})


def encoded(rows: DataFrame, event: EventType, name: str = "fields") -> DataFrame:
    """``rows`` with a binary column of the type's fields, from columns of the fields' names (bytes default to zeros).

    Numbers that a field can't hold wrap; a null becomes the field's sentinel, or 0.
    """
    layout = dtype_of(event)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    columns = rows.columns
    given = [f for f in event.fields if f.name in columns and f.kind != "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, layout)
            for f in given:
                values = batch.column(columns.index(f.name))
                if pa.types.is_decimal(values.type):
                    raw = np.array([0 if v is None else int(v) & ((1 << 64) - 1) for v in values.to_pylist()], np.uint64)
                else:
                    raw = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                raw = np.where(values.is_null().to_numpy(zero_copy_only=False), np.uint64(f.sentinel or 0), raw)
                width = INTEGERS.get(f.kind) or f.natural_width
                out[f.name] = raw.astype(f"<u{width}").view(layout[f.name])
            size = layout.itemsize
            data = out.tobytes()
            body = pa.array([data[i : i + size] for i in range(0, len(data), size)] if size else [b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, body], names=[*columns, name])

    return rows.mapInArrow(run, schema)
