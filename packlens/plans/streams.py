"""Queries that run a stream over all events there are and return what it gave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sequence import good_reads
from ..sources.adapters import TRACE, as_trace, nanoseconds
from ..sources.tables import scratch
from ..streaming import traces as op
from .policy import _RUNS, TTL_MS
from .register import query


@query(f"""WITH {TRACE} SELECT op, count(*) AS events, count(*) FILTER (op = 'read') AS reads, coalesce(sum(returned) FILTER (op = 'read'), 0)::BIGINT AS read_bytes FROM trace GROUP BY op""")
def stream_trace_counts(spark, sf_dir):
    events = as_trace(op.open_table(spark, sf_dir, "events"))
    return op.drain(op.counts(events), scratch(spark, "counts"), "complete")


@query(f"""WITH {_RUNS} SELECT seq, path, confidence, forward_bytes, confidence >= 3 AS sequential FROM observed""")
def stream_sequences(spark, sf_dir):
    reads = good_reads(as_trace(op.open_table(spark, sf_dir, "events"))).select("path", "seq", "offset", "returned", "ts_ns")
    return op.drain(op.sequences(reads, TTL_MS, "1 day"), scratch(spark, "sequences"), "append")


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type AS op, count(*) AS events FROM events GROUP BY ALL""")
def stream_window_counts(spark, sf_dir):
    """Counts by day and kind, whatever the session's zone; complete mode, so that the last windows are given too."""
    events = op.open_table(spark, sf_dir, "events").select(F.timestamp_micros((nanoseconds(F.col("ts")) / 1000).cast("long")).alias("ts"), F.col("event_type").alias("op"))
    return op.drain(op.windowed_counts(events, "1 day", "1 hour"), scratch(spark, "windows"), "complete").select(F.date_from_unix_date(F.expr("unix_micros(start) div 86400000000").cast("int")).cast("string").alias("day"), "op", "events")
