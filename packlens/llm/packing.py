"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups.

Each document becomes its token ids and an end id, cut into pieces of at most the sequence length. The
pieces of about PER_GROUP documents, dealt out by a hash, form a group and are packed on their own.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, prepare
from .shingles import mix

LENGTH, END, PER_GROUP = 1024, 0, 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids by a byte-level BPE file of the tokenizers library, special tokens added to none.

    Ordinary text goes through tiktoken with the same vocabulary, which gives the same ids several
    times as fast; a text that spells out a special token goes through tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = tokenizers.Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(path: str, length: int, groups: int, end: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            seen: dict[tuple, int] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                key = (doc_id, zlib.crc32(ids.tobytes()))
                seen[key] = seen.get(key, -1) + 1  # so that repeated rows do not all meet in one group
                own = (hash((doc_id or 0) % (1 << 61)) * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F + seen[key] * 0x165667B19E3779F9) % (1 << 64)
                group = int(mix(np.array([own], np.uint64))[0] % np.uint64(groups))
                for a in range(0, len(ids), length):
                    piece = ids[a : a + length]
                    for column, x in zip(columns, (doc_id, a, len(piece), zlib.crc32(piece.tobytes()), len(ids), group)):
                        column.append(x)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin_group"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, placed in the given order into the first bin with room.

    The tree's leaves are the bins' free capacities, inner nodes the larger of their two children:
    the leftmost leaf that fits is found from the root, and one path is renewed after each placing.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - tree[at])
        tree[at] -= n
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left >= right else right
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return bins, offsets


def _pack(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(table.column("length").to_pylist(), length)
        sequence = (table.column("bin_group").to_numpy() << 32) + np.array(bins, dtype=np.int64)
        return table.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    A null text is empty and is one piece of the end id alone. A text of many tokens gives full pieces
    and a rest. Repeated rows are packed as often as they occur; null ids are allowed; ids must be long.
    Other columns are ignored. An empty table gives an empty result. The same rows in the same order of
    batches give the same packing; rows that repeat one another may trade places.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = parts(docs.count(), per_group)
    pieces = rows.mapInArrow(_cut(path, length, groups, end), f"{_PIECES}, bin_group long")
    return pieces.groupBy("bin_group").applyInArrow(_pack(length), f"{_PIECES}, sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """One row a piece of every document; see pack."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
