"""Queries that compare inventories, tiers and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as op
from ..operators import tiers
from ..sources.adapters import CHUNKS, FILES, files
from .chunks import _STORED, stored
from .register import query, table

_SIDES = f"""{FILES}, e AS (SELECT path, 'file' AS kind, size, sha256(content) AS sha256 FROM files WHERE doc_id % 10 > 0),
a AS (SELECT path, 'file' AS kind, size, CASE WHEN doc_id % 10 = 2 THEN NULL WHEN doc_id % 10 = 1 THEN sha256(content || '!') ELSE sha256(content) END AS sha256 FROM files WHERE doc_id % 10 <> 3
  UNION ALL SELECT regexp_replace(path, '/([^/]*)$', '/._\\1'), 'file', 50, 'x' FROM files WHERE doc_id % 20 IN (4, 10)),
d AS (SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra'
  WHEN e.size <> a.size OR e.sha256 IS DISTINCT FROM a.sha256 THEN 'changed' END AS state FROM e FULL JOIN a ON e.path = a.path)"""


def _sides(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path", F.lit("file").alias("kind"), "size", F.sha2("content", 256).alias("sha256"), F.sha2(F.concat("content", F.lit("!")), 256).alias("other"))
    digest = F.when(F.col("doc_id") % 10 == 2, None).when(F.col("doc_id") % 10 == 1, F.col("other")).otherwise(F.col("sha256"))
    side = f.where("doc_id % 20 in (4, 10)").select(F.regexp_replace("path", "/([^/]*)$", "/._$1").alias("path"), "kind", F.lit(50).cast("long").alias("size"), F.lit("x").alias("sha256"))
    return f.where("doc_id % 10 > 0"), f.where("doc_id % 10 <> 3").select("path", "kind", "size", digest.alias("sha256")).unionByName(side)


@query(f"WITH {_SIDES} SELECT path, state FROM d WHERE state IS NOT NULL")
def tree_compare(spark, sf_dir):
    return op.inventories(*_sides(spark, sf_dir))


@query(f"""WITH {_SIDES}, x AS (SELECT path, regexp_replace(path, '/\\._([^/]+)$', '/\\1') AS plain FROM d WHERE state = 'extra')
SELECT path, CASE WHEN plain <> path AND plain IN (SELECT e.path FROM e SEMI JOIN a USING (path)) THEN plain END AS companion,
NOT (plain <> path AND plain IN (SELECT e.path FROM e SEMI JOIN a USING (path))) AS unexpected FROM x""")
def sidecar_files(spark, sf_dir):
    expected, actual = _sides(spark, sf_dir)
    return op.sidecars(op.inventories(expected, actual), expected, actual)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem)
SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l.l_orderkey, l.l_linenumber, l.l_quantity, r.l_quantity FROM l JOIN r USING (l_orderkey, l_linenumber) WHERE l.l_quantity IS DISTINCT FROM r.l_quantity) GROUP BY l_orderkey""")
def pair_reads(spark, sf_dir):
    """Reads that differ between two runs, at the scale of lineitem."""
    keys = ("l_orderkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(*keys, "l_quantity")
    b = lines.select(*keys, F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    joined = a.withColumnRenamed("l_quantity", "l").join(b.withColumnRenamed("l_quantity", "r"), list(keys)).where(~F.col("l").eqNullSafe(F.col("r"))).distinct()
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS trial, count(DISTINCT l_returnflag) AS digests FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def digest_groups(spark, sf_dir):
    return op.disagreeing(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_returnflag").alias("digest")), "trial")


_TIERS = f"""{CHUNKS}, {_STORED}, want AS (SELECT hash, raw_size, compressed_size, ascii(hash) % 5 AS a, ascii(substr(hash, 2)) % 4 AS b FROM stored)"""


@query(f"""WITH {_TIERS} SELECT hash, CASE WHEN a = 0 THEN 'ok' WHEN a = 1 THEN 'corrupt' WHEN b = 0 THEN 'ok' WHEN b = 1 THEN 'corrupt' WHEN a = 2 THEN 'ok' ELSE 'not found' END AS status,
CASE WHEN a IN (0, 1) THEN 'primary-local' WHEN b IN (0, 1) THEN 'secondary-local' WHEN a = 2 THEN 'remote-http' END AS source FROM want""")
def tier_lookup(spark, sf_dir):
    return tiers.lookup(*_tier_inputs(spark, sf_dir)).select("hash", "status", "source")


@query(f"""WITH {_TIERS}, r AS (SELECT *, CASE WHEN a = 0 THEN 'primary-local' WHEN a > 1 AND b = 0 THEN 'secondary-local' WHEN a = 2 AND b > 1 THEN 'remote-http' END AS source FROM want)
SELECT source, count(*) AS hits, sum(raw_size)::BIGINT AS bytes, count(*) FILTER (source <> 'primary-local') AS promotions,
coalesce(sum(raw_size) FILTER (source <> 'primary-local'), 0)::BIGINT AS promotion_bytes FROM r WHERE source IS NOT NULL GROUP BY source""")
def tier_counters(spark, sf_dir):
    return tiers.counters(tiers.lookup(*_tier_inputs(spark, sf_dir)))


def _tier_inputs(spark, sf_dir):
    s = stored(spark, sf_dir).withColumn("a", F.ascii("hash") % 5).withColumn("b", F.ascii(F.substring("hash", 2, 62)) % 4)
    good = lambda c: F.when(c, F.col("raw_size")).otherwise(F.col("raw_size") + 1)
    primary = s.where("a in (0, 1)").select("hash", good(F.col("a") == 0).alias("raw_size"))
    secondary = s.where("b in (0, 1)").select("hash", good(F.col("b") == 0).alias("raw_size"))
    return s.select("hash", "raw_size"), [("primary-local", primary), ("secondary-local", secondary), ("remote-http", s.where("a = 2").select("hash", "raw_size"))]
