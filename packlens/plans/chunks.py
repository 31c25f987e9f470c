"""Queries on chunks, objects, packs and reuse between versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cas
from ..operators.chunking import fixed_chunks
from ..sources.adapters import CHUNK, CHUNKS, FILES, files
from .register import query

#: The driver's texts stand for stored objects; this share of a chunk's size stands for its encoding.
_STORED = "stored AS (SELECT hash, raw_size, raw_size - raw_size // 3 AS compressed_size FROM (SELECT DISTINCT hash, raw_size FROM chunks))"
_VERSIONS = f"{CHUNKS}, v1 AS (SELECT * FROM chunks WHERE doc_id % 2 = 0), v2 AS (SELECT * FROM chunks WHERE doc_id % 2 = 1)"


def chunks(spark, sf_dir):
    return fixed_chunks(files(spark, sf_dir).select("doc_id", "path", "content"), CHUNK)


def stored(spark, sf_dir):
    return chunks(spark, sf_dir).select("hash", "raw_size").distinct().withColumn("compressed_size", F.expr("raw_size - raw_size div 3"))


@query(f'WITH {CHUNKS} SELECT doc_id, path, ordinal, "offset", raw_size, hash FROM chunks')
def chunk_fixed(spark, sf_dir):
    return chunks(spark, sf_dir)


@query(f"""WITH {FILES}, numbered AS (SELECT path, size, hex(encode(content)) AS h, unnest(range(0, size, 4096)) AS "offset" FROM files)
SELECT path, "offset" // 4096 AS ordinal, "offset", least(4096, size - "offset") AS raw_size, sha256(unhex(substr(h, 2 * "offset" + 1, 8192))) AS hash FROM numbered""")
def chunk_fixed_bytes(spark, sf_dir):
    return fixed_chunks(files(spark, sf_dir).select("path", F.encode("content", "UTF-8").alias("content")), 4096)


@query(f"""WITH {CHUNKS} SELECT hash, first(raw_size ORDER BY path, ordinal) AS raw_size, count(*) AS "references",
first(path ORDER BY path, ordinal) AS first_path, first(ordinal ORDER BY path, ordinal) AS first_ordinal FROM chunks GROUP BY hash""")
def dedup_objects(spark, sf_dir):
    return cas.objects(chunks(spark, sf_dir))


@query(f"""WITH {CHUNKS}, {_STORED} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(size)::BIGINT FROM files) AS logical_bytes,
(SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT hash) FROM chunks) AS unique_objects, (SELECT sum(compressed_size)::BIGINT FROM stored) AS object_bytes,
(SELECT count(*) * 56 + 16 FROM stored) AS index_bytes, (SELECT count(*) - count(DISTINCT hash) FROM chunks) AS reused_chunks""")
def pack_stats(spark, sf_dir):
    return cas.pack_statistics(files(spark, sf_dir), chunks(spark, sf_dir), stored(spark, sf_dir))


@query(f"""WITH {FILES} SELECT coalesce(sum(size) FILTER (nth > 1), 0)::BIGINT AS bytes, count(*) FILTER (nth > 1) AS occurrences
FROM (SELECT size, row_number() OVER (PARTITION BY sha256(content) ORDER BY path) AS nth FROM files)""")
def duplicate_file_bytes(spark, sf_dir):
    return cas.repeated_bytes(files(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), "size"), "size")


@query(f"""WITH {CHUNKS} SELECT coalesce(sum(raw_size) FILTER (nth > 1), 0)::BIGINT AS bytes, count(*) FILTER (nth > 1) AS occurrences
FROM (SELECT raw_size, row_number() OVER (PARTITION BY hash ORDER BY path, ordinal) AS nth FROM chunks)""")
def chunk_reuse_bytes(spark, sf_dir):
    return cas.repeated_bytes(chunks(spark, sf_dir))


@query(f"""WITH {_VERSIONS}, joint AS (SELECT hash, raw_size FROM v1 UNION ALL SELECT hash, raw_size FROM v2),
r AS (SELECT count(*) AS chunks, sum(raw_size)::BIGINT AS bytes, count(*) FILTER (known) AS reused_chunks, coalesce(sum(raw_size) FILTER (known), 0)::BIGINT AS reused_bytes
      FROM (SELECT raw_size, hash IN (SELECT hash FROM v1) AS known FROM v2)),
u AS (SELECT sum(s)::BIGINT AS unique_bytes FROM (SELECT min(raw_size) AS s FROM joint GROUP BY hash)), t AS (SELECT sum(raw_size)::BIGINT AS total_bytes FROM joint)
SELECT *, reused_bytes / bytes AS reuse_ratio, unique_bytes / total_bytes AS unique_ratio FROM r, u, t""")
def version_reuse(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return cas.version_reuse(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


@query(f"""WITH {_VERSIONS} SELECT coalesce(a.hash, b.hash) AS hash, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'old' ELSE 'both' END AS state
FROM (SELECT DISTINCT hash FROM v1) a FULL JOIN (SELECT DISTINCT hash FROM v2) b ON a.hash = b.hash""")
def version_set_diff(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return cas.set_difference(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


@query(f"""WITH {_VERSIONS}, {_STORED} SELECT count(*) AS new_objects, coalesce(sum(compressed_size), 0)::BIGINT AS payload_bytes,
coalesce(sum(compressed_size), 0)::BIGINT + 4096 + 8 AS update_bytes FROM stored WHERE hash IN (SELECT hash FROM v2) AND hash NOT IN (SELECT hash FROM v1)""")
def update_budget(spark, sf_dir):
    s, c = stored(spark, sf_dir), chunks(spark, sf_dir)
    old, new = (s.join(c.where(f"doc_id % 2 = {i}").select("hash"), "hash", "left_semi") for i in (0, 1))
    return cas.update_budget(old, new, 4096)


@query(f"""WITH RECURSIVE {CHUNKS}, {_STORED}, ordered AS (SELECT *, substr(hash, 1, 2) AS shard, row_number() OVER (PARTITION BY substr(hash, 1, 2) ORDER BY hash) AS i FROM stored),
placed AS (
  SELECT shard, i, hash, compressed_size, 0::BIGINT AS pack_id, 8::BIGINT AS pack_offset FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.shard, o.i, o.hash, o.compressed_size,
         CASE WHEN p.pack_offset + p.compressed_size + o.compressed_size > 4096 THEN p.pack_id + 1 ELSE p.pack_id END,
         CASE WHEN p.pack_offset + p.compressed_size + o.compressed_size > 4096 THEN 8 ELSE p.pack_offset + p.compressed_size END
  FROM placed p JOIN ordered o ON o.shard = p.shard AND o.i = p.i + 1
) SELECT shard, hash, compressed_size, pack_id, pack_offset FROM placed""")
def pack_placement(spark, sf_dir):
    rows = stored(spark, sf_dir).select(F.substring("hash", 1, 2).alias("shard"), "hash", "compressed_size")
    return cas.place(rows, "shard", "compressed_size", ("hash",), 4096)


@query(f"""WITH {CHUNKS} SELECT hash, 'objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3) || '.pso' AS path, printf('pack-%04d.psp', (ascii(hash) % 50)::INT) AS pack
FROM (SELECT DISTINCT hash FROM chunks)""")
def object_layout(spark, sf_dir):
    h = chunks(spark, sf_dir).select("hash").distinct()
    return h.select("hash", cas.loose_path(F.col("hash")).alias("path"), cas.pack_name(F.ascii("hash") % 50).alias("pack"))


@query(f"WITH {FILES} SELECT path, coalesce(size, 0) AS size, sha256(coalesce(content, '')) AS hash FROM files")
def whole_file_digests(spark, sf_dir):
    """Files put together again from their chunks."""
    f = files(spark, sf_dir).select("path", "content")
    return cas.whole_files(f, fixed_chunks(f, CHUNK, digest=False))


@query(f"""WITH {FILES} SELECT sha256(string_agg(path || ':' || size || ':' || sha256(content), chr(10) ORDER BY path || ':' || size || ':' || sha256(content))) AS tree_sha256,
count(*) AS files, sum(size)::BIGINT AS bytes FROM files""")
def tree_digest(spark, sf_dir):
    return cas.tree_digest(files(spark, sf_dir).select("path", "size", F.sha2("content", 256).alias("hash")))


@query(f"""WITH {FILES} SELECT split_part(path, '/', 1) AS directory, count(*) AS files, sum(size)::BIGINT AS bytes,
sha256(string_agg(path || ':' || size || ':' || sha256(content), chr(10) ORDER BY path || ':' || size || ':' || sha256(content))) AS sha256 FROM files GROUP BY 1""")
def directory_digests(spark, sf_dir):
    return cas.directory_digests(files(spark, sf_dir).select("path", "size", F.sha2("content", 256).alias("hash")))


@query(f"""WITH {CHUNKS}, {_STORED} SELECT count(*) AS objects, coalesce(sum(raw_size) FILTER (compressed_size < raw_size), 0)::BIGINT AS compressible_bytes,
coalesce(sum(raw_size) FILTER (compressed_size >= raw_size), 0)::BIGINT AS incompressible_bytes FROM stored""")
def codec_split(spark, sf_dir):
    small = F.col("compressed_size") < F.col("raw_size")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("raw_size"))), F.lit(0))
    return stored(spark, sf_dir).agg(F.count("*").alias("objects"), total(small).alias("compressible_bytes"), total(~small).alias("incompressible_bytes"))


@query(f"""WITH {CHUNKS}, {_STORED}, kept AS (SELECT * FROM stored WHERE ascii(hash) % 7 > 0)
SELECT path, ordinal, hash, raw_size FROM chunks ANTI JOIN kept USING (hash, raw_size)""")
def fk_violations(spark, sf_dir):
    """Chunks whose object is not in a store that lacks some."""
    kept = stored(spark, sf_dir).where(F.ascii("hash") % 7 > 0)
    return cas.missing(chunks(spark, sf_dir), kept).select("path", "ordinal", "hash", "raw_size")


@query(f"WITH {CHUNKS}, {_STORED} SELECT hash, raw_size FROM stored WHERE hash NOT IN (SELECT hash FROM chunks WHERE doc_id % 5 > 0)")
def orphan_objects(spark, sf_dir):
    return cas.orphans(stored(spark, sf_dir), chunks(spark, sf_dir).where("doc_id % 5 > 0")).select("hash", "raw_size")


@query(f"WITH {CHUNKS}, {_STORED} SELECT count(*) AS chunks, count(s.hash) AS resolved, sum(s.compressed_size)::BIGINT AS encoded_bytes FROM chunks c LEFT JOIN stored s USING (hash, raw_size)")
def object_lookup(spark, sf_dir):
    """Every chunk with its object: an equi-join, by broadcast only where Spark finds the side small."""
    joined = chunks(spark, sf_dir).join(stored(spark, sf_dir).withColumn("found", F.lit(1)), ["hash", "raw_size"], "left")
    return joined.agg(F.count("*").alias("chunks"), F.count("found").alias("resolved"), F.sum("compressed_size").alias("encoded_bytes"))


@query("""SELECT l_orderkey, count(*) AS lines FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderkey % 11 > 0) o ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def lineitem_fk_violations(spark, sf_dir):
    """The same foreign-key check at the scale of lineitem."""
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    lacking = lines.join(orders.where("o_orderkey % 11 > 0"), lines["l_orderkey"] == orders["o_orderkey"], "left_anti")
    return lacking.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
