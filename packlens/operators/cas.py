"""Content-addressed storage: objects, reuse, packs, store comparison, digests of whole trees.

Chunks have path, ordinal, hash, offset, raw_size; objects have hash and what the store knows of it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

PACK_HEADER, PACK_LIMIT, RECORD_BYTES, INDEX_HEADER = 8, 256 << 20, 56, 16


def objects(chunks: DataFrame) -> DataFrame:
    """One row a hash: raw_size, references, and the first chunk that has it (by path and ordinal)."""
    first = F.min(F.struct("path", "ordinal", "raw_size"))
    return chunks.groupBy("hash").agg(first.alias("f"), F.count("*").alias("references")).select("hash", "f.raw_size", "references", F.col("f.path").alias("first_path"), F.col("f.ordinal").alias("first_ordinal"))


def repeated_bytes(rows: DataFrame, size: str = "raw_size") -> DataFrame:
    """One row: bytes of every occurrence of a hash after the first, and how many those are."""
    by_hash = rows.groupBy("hash").agg(F.min(size).alias("size"), F.count("*").alias("n"))
    return by_hash.agg(F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("occurrences"))


def pack_statistics(files: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: files, logical, object and index bytes, unique objects, reused chunks.

    stored: hash, compressed_size.
    """
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("hash").alias("unique_objects"))
    o = stored.agg(F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("object_bytes"), (F.count("*") * RECORD_BYTES + INDEX_HEADER).alias("index_bytes"))
    return f.join(c, F.lit(True), "left").join(o, F.lit(True), "left").withColumn("reused_chunks", F.col("chunks") - F.col("unique_objects"))


def missing(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks without an object of their hash and raw size."""
    return chunks.join(stored.select("hash", "raw_size"), ["hash", "raw_size"], "left_anti")


def orphans(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    return stored.join(chunks.select("hash"), "hash", "left_anti")


def version_reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: what of the new version's chunks the old version has, and both versions together."""
    known = old.select("hash").distinct().withColumn("known", F.lit(True))
    seen = F.coalesce("known", F.lit(False))
    size = F.col("raw_size")
    reuse = new.join(known, "hash", "left").agg(F.count("*").alias("chunks"), F.sum(size).alias("bytes"), F.count_if(seen).alias("reused_chunks"), F.coalesce(F.sum(F.when(seen, size)), F.lit(0)).alias("reused_bytes"))
    both = old.select("hash", "raw_size").unionByName(new.select("hash", "raw_size"))
    unique = both.groupBy("hash").agg(F.min("raw_size").alias("raw_size")).agg(F.sum("raw_size").alias("unique_bytes"))
    total = both.agg(F.sum("raw_size").alias("total_bytes"))
    out = reuse.join(unique, F.lit(True), "left").join(total, F.lit(True), "left")
    return out.withColumn("reuse_ratio", F.col("reused_bytes") / F.col("bytes")).withColumn("unique_ratio", F.col("unique_bytes") / F.col("total_bytes"))


def set_difference(old: DataFrame, new: DataFrame, by: str = "hash") -> DataFrame:
    """Each hash of either side with where it is: both, old or new."""
    a, b = old.select(by).distinct().withColumn("a", F.lit(1)), new.select(by).distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "old").otherwise("both")
    return a.join(b, by, "full_outer").select(by, state.alias("state"))


def update_budget(old: DataFrame, new: DataFrame, metadata_bytes: int) -> DataFrame:
    """One row: objects and bytes an update fetches: payloads the old store lacks, the new store's
    metadata and one pack header. old and new: hash, compressed_size."""
    lacking = new.join(old.select("hash"), "hash", "left_anti")
    out = lacking.agg(F.count("*").alias("new_objects"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("payload_bytes"))
    return out.withColumn("update_bytes", F.col("payload_bytes") + metadata_bytes + PACK_HEADER)


def _place(limit: int, size: str, by: tuple[str, ...]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in by])
        packs, offsets, pack, end = [], [], 0, PACK_HEADER
        for i, n in enumerate(table.column(size).to_pylist()):
            if i and end + n > limit:
                pack, end = pack + 1, PACK_HEADER
            packs.append(pack)
            offsets.append(end)
            end += n
        return table.append_column("pack_id", pa.array(packs, pa.int64())).append_column("pack_offset", pa.array(offsets, pa.int64()))

    return run


def place(stored: DataFrame, shard: str, size: str, by: tuple[str, ...], limit: int = PACK_LIMIT) -> DataFrame:
    """The rows with pack_id and pack_offset: packed one behind the other in the order of ``by``, a new
    pack begun when the next object would pass the limit.

    Where a pack begins depends on all that was placed before, so each shard (a hash prefix, say) is
    a sequence of packs of its own; one shard is what one task holds.
    """
    ship(stored.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.groupBy(shard).applyInArrow(_place(limit, size, by), f"{kinds}, pack_id long, pack_offset long")


def loose_path(digest, suffix: str = ".pso"):
    """objects/ab/cd... of a hex digest abcd..."""
    return F.concat(F.lit("objects/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 1 << 10), F.lit(suffix))


def pack_name(pack_id, suffix: str = ".psp"):
    return F.format_string("pack-%04d" + suffix, pack_id)


def whole_files(files: DataFrame, chunks: DataFrame, data: str = "data") -> DataFrame:
    """path, size, hash of ``files`` (path) put together from their chunks in order; data is text or
    binary. A file without chunks is empty. Only as many bytes as a file has meet in one row.
    """
    ordered = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", data))).alias("parts"))
    joined = F.coalesce(F.array_join(F.transform("parts", lambda x: x[data]), ""), F.lit(""))
    return files.select("path").join(ordered, "path", "left").select("path", F.octet_length(joined).cast("long").alias("size"), F.sha2(joined, 256).alias("hash"))


def tree_digest(files: DataFrame, digest: str = "hash") -> DataFrame:
    """One row: SHA-256 of the sorted lines ``path:size:hash`` of all files, which must fit one row;
    by directory first where a tree is large (see plans)."""
    line = F.concat_ws(":", "path", F.col("size").cast("string"), digest)
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_sha256"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def directory_digests(files: DataFrame, digest: str = "hash") -> DataFrame:
    """directory, files, bytes, sha256: tree_digest of each top directory by itself."""
    line = F.concat_ws(":", "path", F.col("size").cast("string"), digest)
    return files.groupBy(F.substring_index("path", "/", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))
