"""Queries that list violations of constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import cas, validity
from ..operators.numbering import numbered
from ..sources.adapters import CHUNKS, FILES, PAGE_PATHS, files, page_paths, trace
from .chunks import _STORED, chunks, stored
from .register import query, table

_BAD = r"[\\:\x00-\x1f\x7f-\x9f]"


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '://(.*)', 1) AS tail FROM pages)
SELECT page_id, url, tail FROM p WHERE tail = '' OR regexp_matches(tail, '[\\x5C:\\x00-\\x1f\\x7f]') OR list_has_any(string_split(tail, '/'), ['', '.', '..'])""")
def path_violations(spark, sf_dir):
    """Pages whose url, behind the scheme, is no valid path."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://(.*)", 1).alias("tail"))
    return validity.bad_paths(rows, "tail")


@query("""SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS previous FROM pages QUALIFY lag(url) OVER (ORDER BY page_id) >= url""")
def sortedness(spark, sf_dir):
    return validity.unsorted(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id")


@query(f"""WITH {PAGE_PATHS} SELECT upper(path) AS name, count(DISTINCT path) AS n, min(path) AS first, max(path) AS last FROM (
  SELECT path FROM page_paths UNION ALL SELECT upper(path) FROM page_paths WHERE page_id % 3 = 0) GROUP BY 1 HAVING count(DISTINCT path) > 1""")
def case_collisions(spark, sf_dir):
    p = page_paths(spark, sf_dir)
    return validity.case_collisions(p.select("path").unionAll(p.where("page_id % 3 = 0").select(F.upper("path"))))


@query(f"""WITH {FILES}, dirs AS (SELECT DISTINCT split_part(path, '/', 1) AS path FROM files WHERE doc_id % 2 = 0),
parts AS (SELECT DISTINCT string_split(path, '/') AS p FROM files), implied AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM parts, range(1, 3) r(i))
SELECT path FROM implied ANTI JOIN dirs USING (path)""")
def missing_ancestors(spark, sf_dir):
    f = files(spark, sf_dir)
    return validity.missing_ancestors(f, f.where("doc_id % 2 = 0").select(F.substring_index("path", "/", 1).alias("path")).distinct())


@query(f"""WITH {CHUNKS}, part AS (SELECT * FROM chunks WHERE (doc_id + ordinal) % 17 > 0), c AS (SELECT path, sum(raw_size) AS covered FROM part GROUP BY path)
SELECT f.path, 'coverage' AS reason FROM files f LEFT JOIN c USING (path) WHERE coalesce(c.covered, 0) <> length(f.content)""")
def chunk_table_violations(spark, sf_dir):
    whole = files(spark, sf_dir).select("path", F.length("content").cast("long").alias("size"))
    return validity.bad_chunk_tables(whole, chunks(spark, sf_dir).where("(doc_id + ordinal) % 17 > 0"))


@query(f"""WITH {CHUNKS}, {_STORED}, rec AS (SELECT row_number() OVER (ORDER BY hash) AS seq, hash, raw_size, compressed_size, CASE WHEN ascii(hash) % 5 = 0 THEN 'raw' ELSE 'zstd' END AS codec FROM stored)
SELECT seq, hash, 'raw length' AS reason FROM rec WHERE codec = 'raw' AND raw_size <> compressed_size""")
def index_violations(spark, sf_dir):
    codec = F.when(F.ascii("hash") % 5 == 0, "raw").otherwise("zstd")
    return validity.bad_records(numbered(stored(spark, sf_dir).withColumn("codec", codec), ["hash"], "seq"))


@query("SELECT 0 AS pack_id, '' AS hash WHERE false")
def pack_coverage(spark, sf_dir):
    """Nothing: what place() returns has neither gaps nor overlaps."""
    rows = stored(spark, sf_dir).select(F.substring("hash", 1, 2).alias("shard"), "hash", "compressed_size")
    placed = cas.place(rows, "shard", "compressed_size", ("hash",), 4096).withColumn("pack_id", F.xxhash64("shard", "pack_id"))
    return validity.bad_coverage(placed).select(F.col("pack_id").cast("int"), "hash")


@query(f"""WITH {CHUNKS}, {_STORED}, rec AS (SELECT hash, compressed_size, ascii(hash) % 7 AS pack_id FROM stored WHERE ascii(substr(hash, 2)) % 3 > 0),
placed AS (SELECT *, (sum(compressed_size) OVER (PARTITION BY pack_id ORDER BY hash))::BIGINT - compressed_size + 8 AS full_offset FROM (SELECT hash, compressed_size, ascii(hash) % 7 AS pack_id FROM stored)),
kept AS (SELECT placed.* FROM placed SEMI JOIN rec USING (hash))
SELECT pack_id, hash, full_offset AS pack_offset, expected FROM (SELECT *, coalesce(lag(full_offset + compressed_size) OVER (PARTITION BY pack_id ORDER BY full_offset), 8) AS expected FROM kept) WHERE full_offset <> expected""")
def pack_coverage_gaps(spark, sf_dir):
    """Objects behind a gap, in packs that lack some of their objects."""
    from pyspark.sql import Window

    w = Window.partitionBy("pack_id").orderBy("hash")
    s = stored(spark, sf_dir).select("hash", "compressed_size", (F.ascii("hash") % 7).alias("pack_id"))
    s = s.withColumn("pack_offset", F.sum("compressed_size").over(w) - F.col("compressed_size") + 8)
    kept = s.where(F.ascii(F.substring("hash", 2, 62)) % 3 > 0)
    return validity.bad_coverage(kept).select("pack_id", "hash", "pack_offset", "expected")


@query("""WITH t AS (SELECT event_id AS seq, CASE WHEN event_id % 100 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN event_id % 150 = 7 THEN 'a//b' WHEN event_id % 150 = 8 THEN '' ELSE 'ok' END AS path,
  repeat('s', (event_id % 70)::INT) AS session FROM events)
SELECT seq, CASE WHEN version <> 1 THEN 'version' WHEN path = 'a//b' THEN 'path' ELSE 'session' END AS reason FROM t WHERE version <> 1 OR path = 'a//b' OR length(session) > 64""")
def event_violations(spark, sf_dir):
    t = trace(spark, sf_dir)
    path = F.when(F.col("seq") % 150 == 7, "a//b").when(F.col("seq") % 150 == 8, "").otherwise("ok")
    version = F.when(F.col("seq") % 100 == 0, 2).otherwise(1)
    return validity.bad_events(t.withColumn("path", path).withColumn("version", version).withColumn("session", F.repeat(F.lit("s"), (F.col("seq") % 70).cast("int"))))


@query("""WITH n AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE (conv_id + turn) % 6 > 0)
SELECT conv_id, turn FROM n WHERE turn <> coalesce(before + 1, 0)""")
def ordinal_gaps(spark, sf_dir):
    """Turns that do not follow the one before, in conversations that lack some."""
    from pyspark.sql import Window

    some = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 6 > 0")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return some.select("conv_id", "turn", before.alias("before")).where("turn <> coalesce(before + 1, 0)").select("conv_id", "turn")


@query("SELECT o_orderkey, o_orderkey * 64 % 8192 AS size FROM orders WHERE NOT (o_orderkey * 64 % 8192 BETWEEN 4096 AND 4194304 AND (o_orderkey * 64 % 8192) & (o_orderkey * 64 % 8192 - 1) = 0)")
def chunk_size_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 64 % 8192).alias("size"))
    return rows.where(~validity.valid_chunk_size(F.col("size")))


@query(f"""WITH {FILES}, up AS (SELECT path, CASE WHEN doc_id % 40 = 0 THEN 2 + doc_id // 80 ELSE doc_id END AS id FROM files WHERE doc_id % 4 = 0), dead AS (SELECT path FROM files WHERE doc_id % 100 = 0)
SELECT min(path) AS path, 'repeated id' AS reason FROM up GROUP BY id HAVING count(*) > 1
UNION ALL SELECT path, 'id out of range' FROM up WHERE id < 2 OR id >= 900 UNION ALL SELECT path, 'written and removed' FROM up SEMI JOIN dead USING (path)""")
def overlay_violations(spark, sf_dir):
    f = files(spark, sf_dir)
    up = f.where("doc_id % 4 = 0").select("path", F.when(F.col("doc_id") % 40 == 0, 2 + F.expr("doc_id div 80")).otherwise(F.col("doc_id")).alias("id"))
    return validity.overlay_conflicts(up, f.where("doc_id % 100 = 0").select("path"), 900)


@query("""WITH w AS (SELECT page_id, split_part(url, '/', 3) || '/' || (['con', 'CON.txt', 'aux.', 'ok.txt', 'com1', 'lpt0', 'a?b', 'q '])[page_id % 8 + 1] AS path FROM pages)
SELECT page_id, path, page_id % 8 IN (3, 5) AS valid FROM w""")
def windows_paths(spark, sf_dir):
    names = F.array(*map(F.lit, ("con", "CON.txt", "aux.", "ok.txt", "com1", "lpt0", "a?b", "q ")))
    path = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/"), F.element_at(names, (F.col("page_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("valid", paths.valid_windows_path(F.col("path")))
