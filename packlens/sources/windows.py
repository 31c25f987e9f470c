"""Stream lists of Windows files: bounded buffers to rows."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

_HEAD, MOST_STREAMS = struct.Struct("<IIqq"), 4096


def parse_streams(data: bytes) -> list[tuple[str, int, int]]:
    """(name, logical, allocated) of each entry; ValueError for offsets or sizes that the buffer belies."""
    out, at = [], 0
    while True:
        if at + _HEAD.size > len(data):
            raise ValueError("truncated")
        step, size, logical, allocated = _HEAD.unpack_from(data, at)
        text = at + _HEAD.size
        if size % 2 or text + size > len(data) or logical < 0 or allocated < 0:
            raise ValueError("sizes out of bounds")
        name = data[text : text + size].decode("utf-16-le")
        if not (name.startswith(":") and name.endswith(":$DATA")) or "\0" in name:
            raise ValueError("not a data stream")
        out.append((name, logical, allocated))
        if len(out) > MOST_STREAMS:
            raise ValueError("too many streams")
        if not step:
            return out
        if step % 8 or step < _HEAD.size + size or at + step >= len(data):
            raise ValueError("offset out of bounds")
        at += step


def _rows(batches):
    for batch in batches:
        rows = [(path, *s) for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for s in parse_streams(bytes(data))]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "stream", "logical_bytes", "allocated_bytes"])


def streams(buffers: DataFrame) -> DataFrame:
    """path, stream, logical_bytes, allocated_bytes. buffers: path, content."""
    ship(buffers.sparkSession)
    return buffers.select("path", "content").mapInArrow(_rows, "path string, stream string, logical_bytes long, allocated_bytes long")
