"""Queries over access traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as op
from ..sources.adapters import TRACE, trace
from .register import query

_READS = "reads AS (SELECT * FROM trace WHERE op = 'read')"
_RANGES = f"""{TRACE}, {_READS}, ranges AS (
  SELECT path, "offset", requested AS length, count(*) AS events FROM reads GROUP BY ALL
), ids AS (
  SELECT path, row_number() OVER (ORDER BY min(seq)) - 1 AS file_id FROM trace GROUP BY path
)"""
_ADJACENT = f"""{TRACE}, {_READS}, adjacent AS (
  SELECT *, coalesce(lag("offset" + returned) OVER (PARTITION BY session, worker, path ORDER BY seq) = "offset", false) AS sequential FROM reads
)"""


@query(f"""WITH {_ADJACENT}, totals AS (
  SELECT count(*) AS events, count(DISTINCT session) AS sessions, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes,
         coalesce(sum(returned) FILTER (op = 'read'), 0)::BIGINT AS read_bytes, coalesce(sum(returned) FILTER (op = 'write'), 0)::BIGINT AS write_bytes,
         count(*) FILTER (op = 'read' AND cache = 'hit') AS hits, count(*) FILTER (op = 'read' AND cache IN ('miss', 'mixed')) AS misses,
         quantile_disc(latency_ns, 0.5) AS p50, quantile_disc(latency_ns, 0.95) AS p95, quantile_disc(latency_ns, 0.99) AS p99 FROM trace
), uniq AS (SELECT count(*) AS n FROM (SELECT DISTINCT path, "offset", requested FROM reads)), seqs AS (SELECT count(*) FILTER (sequential) AS n FROM adjacent)
SELECT events, sessions, reads AS read_operations, writes AS write_operations, read_bytes, write_bytes, uniq.n AS unique_read_ranges,
       100.0::DOUBLE * (seqs.n / reads) AS sequential_read_percentage, (reads - uniq.n) / reads AS reread_ratio,
       hits / (hits + misses) AS cache_hit_ratio, misses / (hits + misses) AS cache_miss_ratio, p50, p95, p99
FROM totals, uniq, seqs""")
def trace_summary(spark, sf_dir):
    return op.summary(trace(spark, sf_dir))


@query(f"WITH {TRACE} SELECT op, count(*) AS events FROM trace GROUP BY op")
def trace_op_counts(spark, sf_dir):
    return op.counts_by(trace(spark, sf_dir), "op")


@query(f"WITH {TRACE} SELECT source, count(*) AS events FROM trace GROUP BY source")
def trace_source_counts(spark, sf_dir):
    return op.counts_by(trace(spark, sf_dir), "source")


@query(f"WITH {TRACE} SELECT row_number() OVER (ORDER BY session) - 1 AS place, session FROM (SELECT DISTINCT session FROM trace)")
def trace_sessions(spark, sf_dir):
    return op.sessions(trace(spark, sf_dir))


@query(f"WITH {TRACE} SELECT path, count(*) AS events FROM trace GROUP BY path ORDER BY events DESC, path LIMIT 20")
def trace_hot_files(spark, sf_dir):
    return op.hot_files(trace(spark, sf_dir))


@query(f'WITH {_RANGES} SELECT path, "offset", length, events, file_id FROM ranges JOIN ids USING (path) ORDER BY events DESC, file_id, "offset", length LIMIT 20')
def trace_hot_ranges(spark, sf_dir):
    return op.hot_ranges(trace(spark, sf_dir))


@query(f"WITH {_RANGES} SELECT path, file_id FROM ids")
def trace_file_ids(spark, sf_dir):
    return op.file_ids(trace(spark, sf_dir))


@query(f"""WITH {TRACE} SELECT op, quantile_disc(latency_ns, 0.5) AS p50, quantile_disc(latency_ns, 0.95) AS p95, quantile_disc(latency_ns, 0.99) AS p99
FROM trace GROUP BY op""")
def trace_latency_percentiles(spark, sf_dir):
    return op.nearest_ranks(trace(spark, sf_dir), ["op"], "latency_ns")


@query(f"WITH {_ADJACENT} SELECT path, count(*) AS reads, count(*) FILTER (sequential) AS sequential, 100.0::DOUBLE * (count(*) FILTER (sequential) / count(*)) AS percentage FROM adjacent GROUP BY path")
def trace_sequential_pct(spark, sf_dir):
    reads = op.adjacency(trace(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("reads"), F.count_if("sequential").alias("sequential"))
    return reads.withColumn("percentage", 100.0 * op.ratio(F.col("sequential"), F.col("reads")))


@query(f"WITH {_RANGES} SELECT path, count(*) AS distinct_ranges, sum(events)::BIGINT AS reads, (sum(events) - count(*)) / sum(events) AS reread_ratio FROM ranges GROUP BY path")
def trace_distinct_ranges(spark, sf_dir):
    out = op.read_ranges(trace(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("distinct_ranges"), F.sum("events").alias("reads"))
    return out.withColumn("reread_ratio", op.ratio(F.col("reads") - F.col("distinct_ranges"), F.col("reads")))


@query(f"""WITH {TRACE}, arrived AS (
  SELECT seq // 2048 AS period, row_number() OVER (PARTITION BY seq // 2048 ORDER BY seq) <= 1024 AS kept FROM trace
) SELECT period, count(*) AS seen, count(*) FILTER (kept) AS written, count(*) FILTER (NOT kept) AS dropped,
         count(*) FILTER (kept) AS queue_high_watermark, 0 AS writer_errors, count(*) = count(*) FILTER (kept) + count(*) FILTER (NOT kept) AS conserved FROM arrived GROUP BY period""")
def trace_drop_accounting(spark, sf_dir):
    return op.accounting(trace(spark, sf_dir), 1024)


@query(f"""WITH {TRACE}, arrived AS (
  SELECT seq, seq // 200 AS period, row_number() OVER (PARTITION BY seq // 200 ORDER BY seq) <= 100 AS queued FROM trace
), judged AS (SELECT *, queued AND seq < 500 AS kept, seq = (SELECT min(seq) FROM arrived WHERE queued AND seq >= 500) AS failed FROM arrived)
SELECT period, count(*) AS seen, count(*) FILTER (kept) AS written, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (queued) AS queue_high_watermark,
       count(*) FILTER (failed) AS writer_errors, count(*) = count(*) FILTER (kept) + count(*) FILTER (NOT kept) AS conserved FROM judged GROUP BY period""")
def trace_writer_failure(spark, sf_dir):
    """A writer that fails at the 500th event: all behind it is dropped and counted."""
    return op.accounting(trace(spark, sf_dir), 100, 500)


@query(f"""WITH {TRACE}, reads AS (SELECT path, bool_or(cache IN ('hit', 'mixed')) AS hit, bool_or(cache IN ('miss', 'mixed')) AS miss,
         count(DISTINCT source) AS sources, min(source) AS one, bool_or(NOT success) AS failed FROM trace WHERE op = 'read' GROUP BY session, path, "offset")
SELECT CASE WHEN hit AND miss THEN 'mixed' WHEN hit THEN 'hit' WHEN miss THEN 'miss' ELSE 'bypass' END AS outcome,
       CASE WHEN sources > 1 THEN 'mixed' ELSE coalesce(one, CASE WHEN failed THEN 'unresolved' ELSE 'primary-local' END) END AS source, count(*) AS n
FROM reads GROUP BY ALL""")
def read_outcomes(spark, sf_dir):
    """The cache outcome and source of reads made of several chunk lookups: here, those of one place."""
    reads = trace(spark, sf_dir).where("op = 'read'").groupBy("session", "path", "offset").agg(
        F.bool_or(F.col("cache").isin("hit", "mixed")).alias("hit"), F.bool_or(F.col("cache").isin("miss", "mixed")).alias("miss"),
        F.count_distinct("source").alias("sources"), F.min("source").alias("one"), F.bool_or(~F.col("success")).alias("failed"))
    outcome = F.when(F.col("hit") & F.col("miss"), "mixed").when(F.col("hit"), "hit").when(F.col("miss"), "miss").otherwise("bypass")
    source = F.when(F.col("sources") > 1, "mixed").otherwise(F.coalesce("one", F.when(F.col("failed"), "unresolved").otherwise("primary-local")))
    return reads.groupBy(outcome.alias("outcome"), source.alias("source")).agg(F.count("*").alias("n"))
