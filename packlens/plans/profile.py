"""Queries on content profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as op
from ..sources.adapters import FILES, files
from .register import query, table

_ENDINGS = ("zip", "PAK", "vpk", "bundle", "exe", "lua", "json", "png", "ogg", "webm", "spv", "dat", "xyz", "so", "pck")
_MAGIC = ("504B0304", "556E6974794653", "4D5A9000", "7F454C46", "00112233", "42534100", "00")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _case(rows, end):
    return "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in rows) + f" ELSE {end} END"


_SQL = f"""named AS (SELECT page_id, split_part(url, '/', 3) || '/a.b/p' || page_id || '.' || ({_LIST(_ENDINGS)})[page_id % {len(_ENDINGS)} + 1] AS path,
  lower(({_LIST(_ENDINGS)})[page_id % {len(_ENDINGS)} + 1]) AS ending, ({_LIST(_MAGIC)})[page_id % {len(_MAGIC)} + 1] AS head, strlen(html)::BIGINT AS size FROM pages),
marked AS (SELECT *, {_case([(f"starts_with(head, '{m}')", n) for m, n in op.SIGNATURES], "NULL")} AS signature,
  {_case([(f"ending IN ({', '.join(repr(x) for x in e)})", n) for n, e in op.HINTS.items()], "NULL")} AS hint FROM named),
classed AS (SELECT *, CASE WHEN signature = 'executable-header' THEN 'code' WHEN hint IS NOT NULL OR signature IS NOT NULL THEN 'container'
  ELSE {_case([(f"ending IN ({', '.join(repr(x) for x in e)})", n) for n, e in op.CLASSES.items()], "'unknown'")} END AS class FROM marked)"""


def classed(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    path = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/a.b/p"), F.col("page_id"), F.lit("."), pick(_ENDINGS))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.unhex(pick(_MAGIC)).alias("head"), F.octet_length("html").cast("long").alias("size"))
    return op.classify(p)


@query(f"WITH {_SQL} SELECT page_id, path, signature, hint, class FROM classed")
def classify_pages(spark, sf_dir):
    return classed(spark, sf_dir).select("page_id", "path", "signature", "hint", "class")


@query(f"WITH {_SQL} SELECT class, count(*) AS files, sum(size)::BIGINT AS bytes FROM classed GROUP BY class")
def class_bytes(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("class").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


_PROBED = f"""{FILES}, o AS (SELECT path, size, hex(encode(content)) AS h, unnest(list_distinct([0, (size - least(size, 256)) // 2, size - least(size, 256)])) AS "offset" FROM files WHERE size > 0),
p AS (SELECT path, size, "offset", substr(h, 2 * "offset" + 1, 512) AS part FROM o),
b AS (SELECT path, "offset", length(part) // 2 AS n, substr(part, 2 * i + 1, 2) AS byte, count(*) AS c FROM p, range(256) r(i) WHERE i < length(part) // 2 GROUP BY ALL),
e AS (SELECT path, "offset", round(-sum(c / n * log2(c / n)) * 1000)::INT AS entropy FROM b GROUP BY ALL),
probed AS (SELECT p.path, p.size, p."offset", length(part) // 2 AS bytes, sha256(unhex(part)) AS digest, e.entropy FROM p JOIN e USING (path, "offset"))"""


def _probed(spark, sf_dir):
    return op.probes(files(spark, sf_dir).select("path", F.encode("content", "UTF-8").alias("content")), 256)


@query(f'WITH {_PROBED} SELECT path, size, "offset", bytes, digest, entropy FROM probed')
def probe_entropy(spark, sf_dir):
    return _probed(spark, sf_dir)


@query(f"""WITH {_PROBED} SELECT path, size, sum(bytes)::BIGINT AS sampled_bytes, count(*) - count(DISTINCT digest) AS repeated,
size >= 768 AND count(*) = 3 AND count(*) = count(DISTINCT digest) AND min(entropy) >= 7900 AS candidate FROM probed GROUP BY path, size""")
def probe_candidates(spark, sf_dir):
    return op.candidates(_probed(spark, sf_dir), 256)


@query(f"WITH {_SQL} SELECT class, coalesce(sum(size) FILTER (page_id % 3 = 0), 0)::BIGINT AS candidate_bytes FROM classed GROUP BY class")
def candidate_bytes(spark, sf_dir):
    rows = classed(spark, sf_dir)
    return rows.groupBy("class").agg(F.coalesce(F.sum(F.when(F.col("page_id") % 3 == 0, F.col("size"))), F.lit(0)).alias("candidate_bytes"))


@query(f"""WITH {_SQL} SELECT page_id, CASE WHEN signature = 'zip-local-header' THEN 'zip-records-cdc' ELSE 'cdc' END AS chunk_strategy,
CASE WHEN page_id % 3 = 0 THEN 'measured-raw' ELSE 'try-zstd' END AS compression_strategy, CASE WHEN page_id % 3 = 0 THEN '{op.REASON_RAW}' ELSE '{op.REASON_ZSTD}' END AS reason,
CASE WHEN signature = 'zip-local-header' THEN 2 ELSE 0 END AS boundaries FROM classed""")
def packing_plans(spark, sf_dir):
    ends = F.when(F.col("signature") == "zip-local-header", F.array(F.lit(10).cast("long"), F.col("size")))
    rows = classed(spark, sf_dir).withColumn("candidate", F.col("page_id") % 3 == 0).withColumn("boundaries", ends)
    return op.plans(rows, True, True).select("page_id", "chunk_strategy", "compression_strategy", "reason", F.size("boundaries").alias("boundaries"))


@query("SELECT conv_id, list_sort(list(turn)) = list(turn ORDER BY text) AS ascending FROM conversations GROUP BY conv_id")
def boundaries_ascending(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text", "turn"))), lambda x: x["turn"]).alias("ends"))
    return rows.select("conv_id", op.ascending(F.col("ends")).alias("ascending"))


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no plan' WHEN page_id % 5 = 0 THEN 'changed' END AS reason FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0
UNION ALL SELECT 1000000000 + page_id, 'no source' FROM pages WHERE page_id % 11 = 0""")
def stale_plans(spark, sf_dir):
    """Plans as they were stored, some lost, some of sources that are gone, some whose source has changed since."""
    i = F.col("page_id")
    ends = F.when(F.col("signature") == "zip-local-header", F.array(F.lit(10).cast("long"), F.col("size")))
    rows = classed(spark, sf_dir).withColumn("candidate", i % 3 == 0).withColumn("boundaries", ends)
    then = op.plans(rows.withColumn("candidate", F.when(i % 5 == 0, ~F.col("candidate")).otherwise(F.col("candidate"))), True, True).where(i % 7 != 0)
    gone = op.plans(rows.where(i % 11 == 0).withColumn("page_id", i + 1000000000), True, True)
    return op.stale(then.unionByName(gone), rows, "page_id", True, True)


_SPARSE = """f AS (SELECT doc_id, hex(encode(left(coalesce(text, ''), 70))) || repeat('00', 100 + (doc_id % 50)::INT) || CASE WHEN doc_id % 3 = 0 THEN hex(encode(left(coalesce(text, ''), 30))) ELSE '' END AS h FROM documents),
b AS (SELECT doc_id, h, i, substr(h, 64 * i + 1, 64) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 63) // 64)) AS i FROM f)),
d AS (SELECT doc_id, h, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b WHERE trim(part, '0') <> ''),
e AS (SELECT doc_id, min(i) * 32 AS a, least((max(i) + 1) * 32, any_value(len(h)) // 2) AS z, any_value(h) AS h FROM d GROUP BY doc_id, run)"""


@query(f"""WITH {_SPARSE} SELECT doc_id, coalesce((SELECT string_agg(a || '-' || z, ',' ORDER BY a) FROM e WHERE e.doc_id = f.doc_id), '') AS extents,
sha256(unhex(coalesce((SELECT string_agg(printf('%02x%02x000000000000%02x%02x000000000000', a % 256, a // 256, z % 256, z // 256) || substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) FROM e WHERE e.doc_id = f.doc_id), ''))) AS fingerprint FROM f""")
def data_extents(spark, sf_dir):
    """Files with holes: beginnings of the texts, zeros, and for some of them a little text again."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    more = F.when(i % 3 == 0, F.encode(F.left(text, F.lit(30)), "UTF-8")).otherwise(F.lit(b""))
    hole = F.unhex(F.repeat(F.lit("00"), (100 + i % 50).cast("int")))
    f = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode(F.left(text, F.lit(70)), "UTF-8"), hole, more).alias("content"))
    found = f.withColumn("found", op.extents(F.col("content"), 32))
    shown = F.array_join(F.transform("found", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", shown.alias("extents"), op.extents_digest(F.col("content"), F.col("found")).alias("fingerprint"))
