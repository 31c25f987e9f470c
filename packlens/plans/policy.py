"""Queries on sequential access and the policy derived from a trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as op
from ..sources.adapters import TRACE, trace
from .register import query

#: The driver's events are minutes apart; a run may pause for a day.
TTL_MS = 86_400_000

_READS = f"{TRACE}, reads AS (SELECT *, \"offset\" + returned AS ended, ts_ns // 1000000 AS at_ms FROM trace WHERE op = 'read' AND success AND returned > 0)"
_RUNS = f"""{_READS}, steps AS (
  SELECT *, coalesce("offset" > lag("offset") OVER w AND "offset" <= lag(ended) OVER w AND ended > lag(ended) OVER w
                     AND greatest(0, at_ms - lag(at_ms) OVER w) <= {TTL_MS}, false) AS goes_on, ended - lag(ended) OVER w AS step
  FROM reads WINDOW w AS (PARTITION BY path ORDER BY seq)
), runs AS (
  SELECT *, (sum((NOT goes_on)::INT) OVER (PARTITION BY path ORDER BY seq))::BIGINT AS run, CASE WHEN goes_on THEN step ELSE returned END AS gain FROM steps
), observed AS (
  SELECT seq, path, run, row_number() OVER w AS confidence, (sum(gain) OVER w)::BIGINT AS forward_bytes, "offset", returned
  FROM runs WINDOW w AS (PARTITION BY path, run ORDER BY seq)
)"""


@query(f"WITH {_RUNS} SELECT seq, path, run, confidence, forward_bytes, confidence >= 3 AS sequential FROM observed")
def policy_sequences(spark, sf_dir):
    return op.sequences(op.good_reads(trace(spark, sf_dir)), TTL_MS).select("seq", "path", "run", "confidence", "forward_bytes", "sequential")


@query(f"WITH {_RUNS} SELECT count(*) AS reads, count(*) FILTER (confidence >= 3) AS sequential, count(*) FILTER (confidence >= 3) / count(*) >= 0.2 AS enabled FROM observed")
def policy_prefetch_flag(spark, sf_dir):
    return op.prefetch_enabled(trace(spark, sf_dir), TTL_MS)


@query(f"""WITH RECURSIVE {_READS}, numbered AS (SELECT path, row_number() OVER (ORDER BY seq) AS epoch FROM reads),
steps AS (SELECT path, epoch, row_number() OVER w AS i, epoch - lag(epoch) OVER w AS gap FROM numbered WINDOW w AS (PARTITION BY path ORDER BY epoch)),
fold AS (
  SELECT path, i, epoch, 1::BIGINT AS heat FROM steps WHERE i = 1
  UNION ALL
  SELECT s.path, s.i, s.epoch, least(1024, (f.heat >> least(31, s.gap // 64)) + 1) FROM fold f JOIN steps s ON s.path = f.path AND s.i = f.i + 1
) SELECT path, max_by(heat, i) AS heat, max(epoch) AS epoch FROM fold GROUP BY path""")
def policy_heat(spark, sf_dir):
    return op.heat(op.good_reads(trace(spark, sf_dir)))


@query(f"""WITH {TRACE} SELECT path, least(1024, greatest(1, events)) AS priority
FROM (SELECT path, count(*) AS events FROM trace GROUP BY path ORDER BY events DESC, path LIMIT 20)""")
def policy_priority_map(spark, sf_dir):
    return op.priorities(trace(spark, sf_dir))


@query(f"""WITH {_RUNS}, grid AS (SELECT 'f' || f.i AS path, o.i AS ordinal, o.i * 6000 AS start, 6000 AS size FROM range(20) f(i), range(8) o(i)),
last AS (
  SELECT o.path, o.seq, o.forward_bytes, max(g.ordinal) AS last, max_by(g.size, g.ordinal) AS size FROM observed o JOIN grid g
  ON g.path = o.path AND g.start < o."offset" + o.returned AND g.start + g.size > o."offset" WHERE o.confidence >= 3 GROUP BY ALL
) SELECT l.seq, l.path, g.ordinal, g.start AS chunk_offset, g.size::BIGINT AS chunk_size FROM last l JOIN grid g ON g.path = l.path AND g.ordinal BETWEEN l.last + 1 AND l.last + 2
WHERE l.forward_bytes >= l.size""")
def policy_lookahead(spark, sf_dir):
    grid = spark.range(160).select(F.concat(F.lit("f"), F.expr("id div 8").cast("string")).alias("path"), (F.col("id") % 8).alias("ordinal"), (F.col("id") % 8 * 6000).alias("offset"), F.lit(6000).cast("long").alias("raw_size"))
    return op.look_ahead(op.sequences(op.good_reads(trace(spark, sf_dir)), TTL_MS), grid)


@query(f"""WITH {_RUNS}, hot AS (SELECT path, least(1024, count(*)) AS priority FROM trace GROUP BY path ORDER BY count(*) DESC, path LIMIT 20)
SELECT path, priority, count(*) AS reads, count(*) FILTER (confidence >= 3) AS sequential FROM observed LEFT JOIN hot USING (path) GROUP BY ALL""")
def policy_suggestion(spark, sf_dir):
    """What a policy would hold of each path: its initial priority and how sequential it is."""
    runs = op.sequences(op.good_reads(trace(spark, sf_dir)), TTL_MS).groupBy("path").agg(F.count("*").alias("reads"), F.count_if("sequential").alias("sequential"))
    return runs.join(op.priorities(trace(spark, sf_dir)), "path", "left")
