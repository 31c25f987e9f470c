"""Binary object indexes, packs and promotion caches: bytes to rows and rows to bytes.

An index is a magic, a 64-bit count and 56-byte records sorted by hash: hash, pack (32 bits), offset
(64), compressed and raw size (32 each), codec (8), three zero bytes; little-endian.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Fixed values of the formats.
MAGIC, PROMOTED_MAGIC, CODECS = b"PSPIDX01", b"PSPTIER1", ("raw", "zstd")
HEADER, RECORD, MOST_OBJECT = 16, 56, 16 << 20
_RECORD = struct.Struct("<32sIQIIB3s")
SCHEMA = "hash string, pack_id long, pack_offset long, compressed_size long, raw_size long, codec string"


def encode(records: list[dict]) -> bytes:
    """An index of records, in the order of their hashes; a hash occurs once."""
    rows = sorted(records, key=lambda r: r["hash"])
    body = b"".join(_RECORD.pack(bytes.fromhex(r["hash"]), r["pack_id"], r["pack_offset"], r["compressed_size"], r["raw_size"], CODECS.index(r["codec"]), b"\0\0\0") for r in rows)
    return MAGIC + struct.pack("<Q", len(rows)) + body


def decode(data: bytes) -> list[dict]:
    """The records of an index; a ValueError for any that the format does not allow."""
    if data[:8] != MAGIC or len(data) < HEADER or struct.unpack_from("<Q", data, 8)[0] * RECORD + HEADER != len(data):
        raise ValueError("not an index of its stated length")
    out, last = [], b""
    for digest, pack, offset, packed, raw, codec, rest in _RECORD.iter_unpack(data[HEADER:]):
        if digest <= last or any(rest):
            raise ValueError("index records out of order, repeated or with reserved bits")
        if codec >= len(CODECS) or not 0 < raw <= MOST_OBJECT or not 0 < packed <= MOST_OBJECT or (CODECS[codec] == "raw" and raw != packed):
            raise ValueError("index record of an unknown codec or impossible size")
        last = digest
        out.append({"hash": digest.hex(), "pack_id": pack, "pack_offset": offset, "compressed_size": packed, "raw_size": raw, "codec": CODECS[codec]})
    return out


_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = ("hash", "pack_id", "pack_offset", "compressed_size", "raw_size", "codec")


def _decode(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = decode(bytes(data))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS)], names=list(_NAMES))


def read_index(blobs: DataFrame) -> DataFrame:
    """The records of indexes given as binary rows (content), such as the binaryFile source has."""
    ship(blobs.sparkSession)
    return blobs.select("content").mapInArrow(_decode, SCHEMA)


def _encode(table: pa.Table) -> pa.Table:
    return pa.table({"shard": table.column("shard").slice(0, 1), "content": pa.array([encode(table.select(list(_NAMES)).to_pylist())], pa.binary())})


def write_index(records: DataFrame, shard: str) -> DataFrame:
    """shard, content: one index for each shard of the records (a hash prefix, say), made in one task."""
    ship(records.sparkSession)
    return records.withColumn("shard", F.col(shard).cast("string")).groupBy("shard").applyInArrow(_encode, "shard string, content binary")


def objects_of(packs: DataFrame, records: DataFrame) -> DataFrame:
    """hash, codec, raw_size, payload: the objects' bytes out of packs (pack_id, content).

    A pack's bytes are sliced where it is; only slices travel on.
    """
    joined = records.join(packs, "pack_id")
    return joined.select("hash", "codec", "raw_size", F.substring("content", (F.col("pack_offset") + 1).cast("int"), F.col("compressed_size").cast("int")).alias("payload"))


def promoted(hash_hex, raw):
    """A promotion-cache entry as an expression: magic, 32-bit length, hash, bytes."""
    size = F.hex(F.octet_length(raw).cast("int"))
    digits = F.lpad(size, 8, "0")
    little = F.concat(F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    return F.concat(F.lit(PROMOTED_MAGIC), F.unhex(little), F.unhex(hash_hex), raw)


def read_promoted(entry, hash_hex, expected):
    """The bytes of an entry, or null where its magic, hash or length is not the expected."""
    good = (F.substring(entry, 1, 8) == F.lit(PROMOTED_MAGIC)) & (F.lower(F.hex(F.substring(entry, 13, 32))) == hash_hex) & (F.octet_length(entry) == expected + 44)
    return F.when(good, F.substring(entry, F.lit(45), expected.cast("int")))
