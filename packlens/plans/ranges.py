"""Queries on byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as op
from ..operators.chunking import fixed_chunks
from ..operators.numbering import numbered
from ..sources.adapters import CHUNK, CHUNKS, FILES, files, trace
from .register import query

#: Reads: the events go round all documents; offsets run over the whole text and behind its end.
_WANTED = """wanted AS (
  SELECT event_id AS seq, f.path, event_id * 37 % (f.chars + 300) AS "offset", CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id * 13 % 3000 END AS len, f.chars
  FROM events JOIN (SELECT path, length(content)::BIGINT AS chars, row_number() OVER (ORDER BY doc_id) - 1 AS nth, count(*) OVER () AS n FROM files) f ON f.nth = event_id % f.n
)"""
_MET = f"""{CHUNKS}, {_WANTED}, met AS (
  SELECT w.seq, w.path, c.ordinal, c.hash, greatest(0, w."offset" - c."offset") AS start, least(least(w."offset" + w.len, w.chars) - c."offset", c.raw_size) AS stop
  FROM wanted w JOIN chunks c ON c.path = w.path AND c."offset" < least(w."offset" + w.len, w.chars) AND c."offset" + c.raw_size > w."offset" AND w.len > 0
)"""


def _inputs(spark, sf_dir):
    whole = files(spark, sf_dir).select("doc_id", "path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), "content")
    nth = numbered(whole.select("doc_id", "path", "size"), ["doc_id"], "nth", 0)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"))
    at = events.withColumn("nth", F.col("seq") % max(1, whole.count())).join(nth, "nth")
    length = F.when(F.col("seq") % 9 == 0, 0).otherwise(F.col("seq") * 13 % 3000).cast("long")
    reads = at.select("seq", "path", (F.col("seq") * 37 % (F.col("size") + 300)).alias("offset"), length.alias("len"))
    return reads, whole, whole.select("path", "content")


@query(f"WITH {_MET} SELECT seq, path, ordinal, hash, start, stop FROM met")
def range_resolve(spark, sf_dir):
    reads, whole, content = _inputs(spark, sf_dir)
    return op.resolve(reads, whole, fixed_chunks(content, CHUNK)).select("seq", "path", "ordinal", "hash", "start", "stop")


@query(f"WITH {_MET} SELECT seq, path, ordinal, hash, start, stop FROM met")
def range_resolve_fixed(spark, sf_dir):
    """The same rows without a residual: fixed-size chunks are found by their number."""
    reads, whole, content = _inputs(spark, sf_dir)
    return op.resolve_fixed(reads, whole, fixed_chunks(content, CHUNK), CHUNK).select("seq", "path", "ordinal", "hash", "start", "stop")


@query(f"""WITH {FILES}, {_WANTED} SELECT w.seq, w.path, substr(f.content, w."offset" + 1, w.len) AS text FROM wanted w JOIN files f USING (path)
WHERE w.len > 0 AND w."offset" < w.chars""")
def range_bytes(spark, sf_dir):
    reads, whole, content = _inputs(spark, sf_dir)
    return op.read_ranges(op.resolve_fixed(reads, whole, fixed_chunks(content, CHUNK, digest=False), CHUNK))


@query(f"""WITH {CHUNKS}, largest AS (SELECT path FROM files ORDER BY length(content) DESC, path DESC LIMIT 1), own AS (SELECT c.* FROM chunks c SEMI JOIN largest USING (path)),
n AS (SELECT count(*) AS n FROM own)
SELECT path, ordinal AS seq, "offset", least(65536, raw_size) AS len FROM own WHERE ordinal < 128
UNION ALL SELECT path, 1000 + cycle * 10 + ordinal, "offset", least(4096, raw_size) FROM own, range(128) r(cycle) WHERE ordinal < 4
UNION ALL SELECT path, 1000 + cycle * 10 + 4, "offset", least(4096, raw_size) FROM range(128) r(cycle), n JOIN own ON own.ordinal = cycle % n.n""")
def synthetic_workload(spark, sf_dir):
    _, whole, content = _inputs(spark, sf_dir)
    return op.synthetic_reads(whole, fixed_chunks(content, CHUNK, digest=False).drop("data"))


@query(f"""WITH {CHUNKS} SELECT path, count(*) AS chunks FROM (
  SELECT path, ordinal, "offset" - coalesce(lag("offset" + raw_size) OVER (PARTITION BY path ORDER BY ordinal), 0) AS gap FROM chunks WHERE (doc_id + ordinal) % 17 > 0
) WHERE gap <> 0 GROUP BY path""")
def chunk_contiguity(spark, sf_dir):
    """Files whose chunk tables have gaps, in tables that lack some chunks."""
    from ..operators.validity import gaps

    some = fixed_chunks(files(spark, sf_dir).select("doc_id", "path", "content"), CHUNK).where("(doc_id + ordinal) % 17 > 0")
    return gaps(some).groupBy("path").agg(F.count("*").alias("chunks"))


@query(f"""WITH {CHUNKS}, r AS (SELECT path, ordinal, (sum(raw_size) OVER (PARTITION BY path ORDER BY ordinal))::BIGINT - raw_size AS computed FROM chunks)
SELECT path, ordinal, computed FROM r""")
def running_offsets(spark, sf_dir):
    """Offsets as running sums of the sizes before."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return fixed_chunks(files(spark, sf_dir).select("path", "content"), CHUNK).select("path", "ordinal", (F.sum("raw_size").over(w) - F.col("raw_size")).alias("computed"))


def reads_of(trace_rows):
    """Successful reads of a trace as a workload; an overlay's own bytes cannot be replayed."""
    kept = trace_rows.where("op = 'read' and success")
    source = F.when(F.col("source") == "overlay", F.raise_error(F.lit("overlay reads cannot be replayed"))).otherwise(F.col("source"))
    return kept.select("seq", "path", "offset", F.col("requested").alias("len"), source.alias("source"))


@query("""WITH t AS (SELECT event_id AS seq, 'f' || (user_id % 20) AS path, (props ->> '$.k')::BIGINT AS k FROM events WHERE event_type IN ('view', 'click'))
SELECT seq, path, k % 8 * 4096 AS "offset", 8192::BIGINT AS len, (['memory-cache', 'primary-local', 'remote-http'])[k % 3 + 1] AS source FROM t""")
def replay_workload(spark, sf_dir):
    return reads_of(trace(spark, sf_dir))


@query(f"""WITH {FILES}, nonempty AS (SELECT path, size, row_number() OVER (ORDER BY path) - 1 AS nth, count(*) OVER () AS n FROM files WHERE size > 0),
asked AS (SELECT i AS seq, ('0x' || substr(md5('plan:file:' || i), 1, 12))::BIGINT AS file, ('0x' || substr(md5('plan:place:' || i), 1, 12))::BIGINT AS place, ([512, 2048, 8192])[i % 3 + 1] AS length FROM range(300) t(i))
SELECT seq, path, place % (size - least(length, size) + 1) AS "offset", least(length, size)::BIGINT AS len FROM asked JOIN nonempty ON nth = file % n""")
def planned_workload(spark, sf_dir):
    """300 reads by a seed, of lengths in turn."""
    return op.planned_reads(files(spark, sf_dir).select("path", "size"), 300, lengths=(512, 2048, 8192))
