"""Views of the driver's tables in the shapes the operators expect, and the same views as SQL.

Each function has its SQL twin as a common table expression, so that a query and its SQL counterpart
begin with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1024


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts):
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")) * 1000


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-trace events in arrival order (seq)."""
    return as_trace(_read(spark, sf_dir, "events"))


def as_trace(e: DataFrame) -> DataFrame:
    """The events table, or a stream of it, as a trace."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "write").when(kind == "signup", "create").otherwise("read")
    returned = F.when(kind == "error", 0).when(k % 10 == 9, 4096).otherwise(8192).cast("long")
    cache = F.when(op != "read", "bypass").otherwise(F.element_at(F.array(*map(F.lit, ("hit", "hit", "miss", "mixed", "bypass"))), (k % 5 + 1).cast("int")))
    source = F.when(op == "write", "overlay").otherwise(F.element_at(F.array(*map(F.lit, ("memory-cache", "primary-local", "remote-http"))), (k % 3 + 1).cast("int")))
    return e.select(
        F.col("event_id").alias("seq"),
        F.lit(1).alias("version"),
        F.col("user_id").cast("string").alias("session"),
        nanoseconds(F.col("ts")).alias("ts_ns"),
        op.alias("op"),
        F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("path"),
        (k % 8 * 4096).alias("offset"),
        F.lit(8192).cast("long").alias("requested"),
        returned.alias("returned"),
        (F.round(F.col("value") * 100).cast("long") * 10).alias("latency_ns"),
        cache.alias("cache"),
        source.alias("source"),
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("worker"),
        (kind != "error").alias("success"),
    )


TRACE = """trace AS (
  SELECT event_id AS seq, 1 AS version, user_id::VARCHAR AS session, epoch_us(ts) * 1000 AS ts_ns,
         CASE event_type WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'create' ELSE 'read' END AS op,
         'f' || (user_id % 20) AS path, k % 8 * 4096 AS "offset", 8192::BIGINT AS requested,
         (CASE WHEN event_type = 'error' THEN 0 WHEN k % 10 = 9 THEN 4096 ELSE 8192 END)::BIGINT AS returned,
         round(value * 100)::BIGINT * 10 AS latency_ns,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'bypass' ELSE (['hit', 'hit', 'miss', 'mixed', 'bypass'])[k % 5 + 1] END AS cache,
         CASE WHEN event_type = 'purchase' THEN 'overlay' ELSE (['memory-cache', 'primary-local', 'remote-http'])[k % 3 + 1] END AS source,
         'w' || (user_id % 4) AS worker, event_type <> 'error' AS success
  FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events)
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their content: path, size in bytes, mode, content."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    mode = F.when(F.col("doc_id") % 3 == 0, 493).otherwise(420)
    return _read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), mode.alias("mode"), F.col("text").alias("content"))


FILES = """files AS (
  SELECT doc_id, source || '/' || lang || '/d' || doc_id AS path, strlen(text)::BIGINT AS size,
         CASE WHEN doc_id % 3 = 0 THEN 493 ELSE 420 END AS mode, text AS content FROM documents
)"""

#: Chunks of CHUNK characters: path, doc_id, ordinal, offset, raw_size, hash, and the whole in chars.
CHUNKS = f"""{FILES}, numbered AS (
  SELECT doc_id, path, content, length(content)::BIGINT AS chars, unnest(range(0, length(content), {CHUNK})) AS "offset" FROM files
), chunks AS (
  SELECT doc_id, path, "offset" // {CHUNK} AS ordinal, "offset", least({CHUNK}, chars - "offset") AS raw_size,
         sha256(substr(content, "offset" + 1, {CHUNK})) AS hash, chars FROM numbered
)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files from the pages: host/path of each url, without what follows ? or #; one row a path."""
    rest = F.regexp_extract("url", r"://([^?#]*)", 1)
    path = F.regexp_replace(rest, "/+$", "")
    return _read(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("size"), "page_id").groupBy("path").agg(F.max("size").alias("size"), F.min("page_id").alias("page_id"))


PAGE_PATHS = """page_paths AS (
  SELECT path, max(size) AS size, min(page_id) AS page_id FROM (
    SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path, strlen(html)::BIGINT AS size, page_id FROM pages
  ) GROUP BY path
)"""
