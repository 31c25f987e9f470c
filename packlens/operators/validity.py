"""Integrity constraints as tables of violations: an empty result is a valid input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, like_windows, valid_hash, valid_path
from .numbering import with_previous

MOST_CHUNK, LEAST_CHUNK_SIZE, MOST_CHUNK_SIZE = 16 << 20, 4096, 4 << 20


def bad_paths(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.where(~valid_path(F.col(path)))


def bad_modes(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("mode") < 0) | (F.col("mode") > 0o777))


def unsorted(rows: DataFrame, key: str, order: str, within: list[str] | None = None) -> DataFrame:
    """Rows not behind the one before them, in the order of ``order`` (within groups, or else overall)."""
    if within:
        rows = rows.withColumn("previous", F.lag(key).over(Window.partitionBy(*within).orderBy(order)))
    else:
        rows = with_previous(rows, [order], key)
    return rows.where(F.col("previous") >= F.col(key))


def repeated(rows: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def case_collisions(rows: DataFrame, path: str = "path") -> DataFrame:
    """Names that are one where case does not matter: how many, and the first and last of them."""
    return rows.groupBy(like_windows(F.col(path)).alias("name")).agg(F.count_distinct(path).alias("n"), F.min(path).alias("first"), F.max(path).alias("last")).where("n > 1")


def gaps(chunks: DataFrame) -> DataFrame:
    """Chunks that do not begin where the one before ends, the first at 0."""
    end = F.lag(F.col("offset") + F.col("raw_size")).over(Window.partitionBy("path").orderBy("ordinal"))
    return chunks.withColumn("gap", F.col("offset") - F.coalesce(end, F.lit(0))).where("gap <> 0")


def bad_chunk_tables(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, reason of files whose chunks are not a table of 0..size without gaps, of sizes 1..16 MiB."""
    sized = chunks.groupBy("path").agg(F.sum("raw_size").alias("covered"), F.count_if((F.col("raw_size") <= 0) | (F.col("raw_size") > MOST_CHUNK)).alias("odd"))
    both = files.select("path", "size").join(sized, "path", "left").join(gaps(chunks).select("path").distinct().withColumn("gap", F.lit(True)), "path", "left")
    reason = F.when(F.coalesce("covered", F.lit(0)) != F.col("size"), "coverage").when(F.col("odd") > 0, "chunk size").when(F.col("gap"), "gap")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def valid_chunk_size(size: Column) -> Column:
    return (size >= LEAST_CHUNK_SIZE) & (size <= MOST_CHUNK_SIZE) & (size.bitwiseAND(size - 1) == 0)


def missing_ancestors(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories that a path implies and the table of directories lacks."""
    implied = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return implied.join(directories.select("path"), "path", "left_anti")


def bad_records(records: DataFrame) -> DataFrame:
    """Index records that are unsorted, repeated or malformed: hash, reason.

    Records have hash, compressed_size, raw_size, codec (raw or zstd) and seq, their place.
    """
    last = F.col("previous")
    size = lambda c: (F.col(c) <= 0) | (F.col(c) > MOST_CHUNK)
    reason = F.when(~valid_hash(F.col("hash")), "hash").when(last >= F.col("hash"), "order").when(size("raw_size") | size("compressed_size"), "length")
    reason = reason.when((F.col("codec") == "raw") & (F.col("raw_size") != F.col("compressed_size")), "raw length").when(~F.col("codec").isin("raw", "zstd"), "codec")
    return with_previous(records, ["seq"], "hash").select("seq", "hash", reason.alias("reason")).where("reason is not null")


def bad_coverage(records: DataFrame, header: int = 8) -> DataFrame:
    """Objects that do not begin where the pack's last one ends, the first behind the header."""
    w = Window.partitionBy("pack_id").orderBy("pack_offset", "hash")
    end = F.coalesce(F.lag(F.col("pack_offset") + F.col("compressed_size")).over(w), F.lit(header).cast("long"))
    return records.withColumn("expected", end).where("pack_offset <> expected")


def trailing_bytes(records: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs whose length is not the end of their last object."""
    ends = records.groupBy("pack_id").agg(F.max(F.col("pack_offset") + F.col("compressed_size")).alias("end"))
    return packs.join(ends, "pack_id", "left").where(~F.col("length").eqNullSafe(F.col("end")))


def bad_events(trace: DataFrame) -> DataFrame:
    """Events of another version, with an unsafe path or an over-long field: seq, reason."""
    from .trace import BOUNDS

    reason = F.when(F.col("version") != 1, "version").when((F.col("path") != "") & ~valid_path(F.col("path")), "path")
    for name, most in BOUNDS.items():
        reason = reason.when(F.octet_length(name) > most, name)
    return trace.select("seq", reason.alias("reason")).where("reason is not null")


def overlay_conflicts(upserts: DataFrame, tombstones: DataFrame, next_id: int) -> DataFrame:
    """Violations in an overlay: repeated ids, ids out of range, paths both written and removed."""
    ids = upserts.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    twice = ids.where("n > 1").select("path", F.lit("repeated id").alias("reason"))
    outside = upserts.where((F.col("id") < 2) | (F.col("id") >= next_id)).select("path", F.lit("id out of range").alias("reason"))
    both = upserts.join(tombstones.select("path"), "path", "left_semi").select("path", F.lit("written and removed").alias("reason"))
    return twice.unionByName(outside).unionByName(both)


def bad_tree(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing or no directory: path, reason."""
    from ..functions.paths import parent

    above = nodes.select(F.col("path").alias("above"), F.col("kind").alias("above_kind"))
    joined = nodes.withColumn("above", parent(F.col("path"))).join(above, "above", "left")
    reason = F.when(F.col("above") == "", None).when(F.col("above_kind").isNull(), "no parent").when(F.col("above_kind") != "directory", "parent is no directory")
    return joined.select("path", reason.alias("reason")).where("reason is not null")


def policy_violations(policies: DataFrame) -> DataFrame:
    """id, reasons of policy records that are out of range. policies: id and the fields of a policy."""
    p = lambda name: F.col(f"prefetch.{name}")
    rules = {
        "version": F.col("version") == 1,
        "cache_bytes": F.col("cache_bytes").isNull() | F.col("cache_bytes").between(0, 4 << 30),
        "eviction": F.col("eviction").isin("lru", "decaying-hotness"),
        "decay_accesses": F.col("decay_accesses").between(1, 1_000_000),
        "sequential_reads": p("sequential_reads").between(2, 32),
        "max_chunks": p("max_chunks").between(1, 8),
        "budget_bytes": p("budget_bytes").between(0, 128 << 20),
        "queue_depth": p("queue_depth").between(1, 256),
        "ttl_ms": p("ttl_ms").between(1, 30_000),
        "files": F.forall(F.map_entries("files"), lambda e: valid_path(e["key"]) & e["value"].between(1, 1024)) & (F.size("files") <= 4096),
    }
    found = F.filter(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items())), lambda x: x.isNotNull())
    return policies.select("id", found.alias("reasons")).where(F.size("reasons") > 0)


def tier_violations(tiers: DataFrame) -> DataFrame:
    """id, reason of tier configurations: promotion without a cache, or remote limits out of range."""
    remote = F.col("remote")
    reason = F.when(F.col("version") != 1, "version").when(F.col("promote") & F.col("primary_cache").isNull(), "promotion without a cache")
    reason = reason.when(remote.isNotNull() & ~F.coalesce(F.col("remote.timeout_ms").between(1, 60_000) & F.col("remote.retries").between(0, 2), F.lit(False)), "remote limits")
    return tiers.select("id", reason.alias("reason")).where("reason is not null")
