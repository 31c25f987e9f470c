"""Cutting files into chunks: of fixed size by expressions, content-defined and at archive records by
Arrow-batched functions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

MASK = (1 << 64) - 1


# The seed of the gear table and the factors of the splitmix64 generator that fills it.
def _gear(seed: int = 0xC0FFEE) -> list[int]:
    """256 words of the splitmix64 generator, each from its own seed."""
    out = []
    for i in range(256):
        z = (seed + i + 0x9E3779B97F4A7C15) & MASK
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ z >> shift) * factor) & MASK
        out.append(z ^ z >> 31)
    return out


GEAR = _gear()


def fixed_chunks(files: DataFrame, size: int, content: str = "content", digest: bool = True) -> DataFrame:
    """path, ordinal, offset, raw_size and hash (SHA-256) of the chunks of each file.

    A string is cut by characters, binary by bytes. The last chunk may be short; an empty file has
    none. The number of chunks of a file is bounded by its own size only.
    """
    length = F.length(content).cast("long")
    cut = files.where(length > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length({content}) - 1) div {size}"))))
    offset = F.col("ordinal") * size
    piece = F.substring(F.col(content), (offset + 1).cast("int"), F.lit(size))
    own = [c for c in files.columns if c != content]
    return cut.select(*own, "ordinal", offset.alias("offset"), F.least(F.lit(size).cast("long"), length - offset).alias("raw_size"), *([F.sha2(piece, 256).alias("hash")] if digest else [piece.alias("data")]))


_GEAR = np.array(GEAR, dtype=np.uint64)


def gear_cuts(data: bytes, least: int, average: int, most: int) -> list[int]:
    """The ends of content-defined chunks: a rolling gear hash, tested from ``least`` bytes on, with a
    strict mask up to the average and a loose one behind it, and a cut at ``most`` in any case.

    A mask looks at the low bits of the hash only, which the last few bytes alone make up. So the hash of
    every place is a sum of shifted columns, and a chunk's end is the next place where it is zero under the
    mask, but for the first few places of the chunk's test, whose hash has fewer bytes behind it.
    """
    if not 0 < least <= average <= most:
        raise ValueError("0 < least <= average <= most is needed")
    # fixed values: one bit more than the average's before it, one less behind
    bits = max(1, round(math.log2(average)))
    strict, loose = (1 << min(63, bits + 1)) - 1, (1 << max(1, bits - 1)) - 1
    reach = strict.bit_length()
    words = _GEAR[np.frombuffer(data, np.uint8)]
    roll = np.zeros(len(data), dtype=np.uint64)
    for step in range(min(reach, len(data))):
        roll[step:] += words[: len(data) - step] << np.uint64(step)
    hits = [np.flatnonzero((roll & np.uint64(mask)) == 0) for mask in (strict, loose)]
    ends, at = [], 0
    while len(data) - at > least:
        start, turn, end = at + least, at + average, min(at + most, len(data))
        found, short = end, 0
        for i in range(start, min(start + reach, end)):
            short = (short << 1) + GEAR[data[i]] & MASK
            if not short & (strict if i < turn else loose):
                found = i + 1
                break
        else:
            for places, low, high in ((hits[0], start + reach, min(turn, end)), (hits[1], max(start + reach, turn), end)):
                k = int(np.searchsorted(places, low))
                if k < len(places) and places[k] < high:
                    found = int(places[k]) + 1
                    break
        ends.append(found)
        at = found
    return ends + ([len(data)] if at < len(data) else [])


def _content_defined(target: int, boundaries: bool):
    def run(batches):
        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), batch.column("content").cast(pa.binary()).to_pylist()
            segments = batch.column("boundaries").to_pylist() if boundaries else [None] * len(paths)
            columns: list[list] = [[] for _ in range(5)]
            for path, data, ends in zip(paths, contents, segments):
                at, ordinal = 0, 0
                for stop in ends or [len(data or b"")]:
                    start = at
                    for end in gear_cuts(data[start:stop], max(1, target // 4), target, target * 4) if data else []:
                        piece = data[at : start + end]
                        for column, x in zip(columns, (path, ordinal, at, len(piece), hashlib.sha256(piece).hexdigest())):
                            column.append(x)
                        at, ordinal = start + end, ordinal + 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "ordinal", "offset", "raw_size", "hash"])

    return run


def content_chunks(files: DataFrame, target: int, boundaries: str | None = None) -> DataFrame:
    """Content-defined chunks of path and content, least target / 4, most target * 4.

    ``boundaries`` names a column of ascending ends (see sources.zipfiles): chunking restarts at each.
    """
    ship(files.sparkSession)
    columns = ["path", "content"] + ([F.col(boundaries).alias("boundaries")] if boundaries else [])
    return files.select(*columns).mapInArrow(_content_defined(target, boundaries is not None), "path string, ordinal long, offset long, raw_size long, hash string")


def chunk_ordinals(offset: Column, end: Column, size: int) -> Column:
    """The ordinals of the fixed-size chunks that the range [offset, end) meets; none if it is empty."""
    return F.when(end > offset, F.sequence(F.floor(offset / size), F.floor((end - 1) / size))).otherwise(F.array().cast("array<bigint>"))
