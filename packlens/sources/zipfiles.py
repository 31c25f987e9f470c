"""Where the records of ZIP archives end: for chunking that restarts at each of them.

Only plain archives count: one volume, no ZIP64, no encryption, entries stored or deflated, that cover
the bytes before the central directory without a gap and say the same in both places.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.paths import is_valid_path
from ..session import ship

MOST_ENTRIES, MOST_DIRECTORY, U32 = 4096, 8 << 20, 0xFFFFFFFF
_END, _CENTRAL, _LOCAL = struct.Struct("<4s4H2IH"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")


def _plain_extra(data: bytes) -> bool:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        kind, size = struct.unpack_from("<2H", data, at)
        at += 4 + size
        if kind == 1 or at > len(data):
            return False
    return True


def record_ends(data: bytes) -> list[int]:
    """The end of each entry in the order of the file, and that of the file; ValueError for other archives."""

    def need(good: bool, what: str) -> None:
        if not good:
            raise ValueError(what)

    tail = max(0, len(data) - 65557)
    at = data.rfind(b"PK\x05\x06", tail)
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\x05\x06", tail, at)
    need(at >= 0, "no end of central directory")
    _, disk, start_disk, here, count, size, begin, _ = _END.unpack_from(data, at)
    need(not disk and not start_disk and here == count and 0 < count <= MOST_ENTRIES and size <= MOST_DIRECTORY and begin != U32 and begin + size == at, "unsupported directory")
    entries, place = [], begin
    for _ in range(count):
        need(place + 46 <= at, "short entry")
        magic, _, _, flags, method, _, _, crc, packed, raw, name_size, extra_size, note_size, volume, _, _, offset = _CENTRAL.unpack_from(data, place)
        end = place + 46 + name_size + extra_size + note_size
        need(magic == b"PK\x01\x02" and not volume and not flags & ~0x0806 and method in (0, 8) and U32 not in (packed, raw, offset) and name_size and end <= at, "unsupported entry")
        name = data[place + 46 : place + 46 + name_size]
        need(is_valid_path(name.decode("utf-8").rstrip("/")) and _plain_extra(data[place + 46 + name_size : end - note_size]), "unsafe entry")
        entries.append((offset, flags, method, crc, packed, raw, name))
        place = end
    need(place == at, "directory has more bytes")
    ends, reached = [], 0
    for offset, flags, method, crc, packed, raw, name in sorted(entries):
        need(offset == reached and offset + 30 <= begin, "gap or overlap")
        magic, _, own_flags, own_method, _, _, own_crc, own_packed, own_raw, name_size, extra_size = _LOCAL.unpack_from(data, offset)
        need(magic == b"PK\x03\x04" and (own_flags, own_method, own_crc, own_packed, own_raw) == (flags, method, crc, packed, raw), "entries differ")
        fields = data[offset + 30 : offset + 30 + name_size + extra_size]
        reached = offset + 30 + len(fields) + packed
        need(reached <= begin and fields[:name_size] == name and _plain_extra(fields[name_size:]) and (method or packed == raw), "entries differ")
        ends.append(reached)
    need(reached == begin, "bytes behind the last entry")
    return [*ends, len(data)]


def _find(batches):
    for batch in batches:
        ends, errors = [], []
        for data in batch.column("content").to_pylist():
            try:
                ends.append(record_ends(bytes(data)))
                errors.append(None)
            except (ValueError, struct.error) as e:
                ends.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(ends, pa.list_(pa.int64())), pa.array(errors, pa.string())], names=["path", "boundaries", "error"])


def boundaries(files: DataFrame) -> DataFrame:
    """path, boundaries (null for what is no such archive), error. files: path, content."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_find, "path string, boundaries array<long>, error string")
