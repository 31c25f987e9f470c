"""Summaries of access traces: counts, totals, exact percentiles, hot files and ranges, adjacency.

A trace has the columns seq, session, worker, op, path, offset, requested, returned, latency_ns, cache,
source, success. seq is the order of arrival, which every order-dependent result follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .numbering import numbered

#: Bounds in bytes of the text fields; longer ones are dropped and counted.
BOUNDS = {"session": 64, "op": 32, "path": 4096, "cache": 32, "source": 32, "worker": 64}


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where there is nothing to divide by."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n / d)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """``by`` and p50, p95, ...: the element at place ceil(n * p / 100) in the order of whole numbers.

    Rows are counted by value, put in order by ranges, and summed up to each value: within a partition
    by a window, over the partitions before by one sum a partition, so that no task or buffer holds all
    values of a group. Nulls do not count; a group without values is left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    order = [*by, "__value"]
    placed = cut(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part", *by)
    sums = placed.groupBy("__part", *by).agg(F.sum("__n").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)) if by else F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__sum").over(Window.partitionBy(*by)) if by else F.sum("__sum").over(Window.partitionBy(F.lit(0)))
    before = sums.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__before"), total.alias("__total"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    upto = F.col("__before") + F.sum("__n").over(own.orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.join(before, same).withColumn("__upto", upto)
    rank = lambda p: F.greatest(F.lit(1), F.expr(f"(__total * {p} + 99) div 100"))
    found = lambda p: F.min(F.when(F.col("__upto") >= rank(p), F.col("__value"))).cast("long").alias(f"p{p}")
    return summed.groupBy(*by).agg(*map(found, points))


def is_read() -> Column:
    return F.col("op") == "read"


def counts_by(trace: DataFrame, key: str) -> DataFrame:
    return trace.groupBy(key).agg(F.count("*").alias("events"))


def sessions(trace: DataFrame) -> DataFrame:
    """The sessions in order, one a row: place from 0, session."""
    return numbered(trace.select("session").distinct(), ["session"], "place", 0).select("place", "session")


def hot_files(trace: DataFrame, k: int = 20) -> DataFrame:
    """The k paths of most events; ties by path."""
    return counts_by(trace, "path").orderBy(F.col("events").desc(), "path").limit(k)


def file_ids(trace: DataFrame) -> DataFrame:
    """path, file_id: numbered from 0 in the order in which paths first occur."""
    first = trace.groupBy("path").agg(F.min("seq").alias("first"))
    return numbered(first, ["first"], "file_id", 0).select("path", "file_id")


def read_ranges(trace: DataFrame) -> DataFrame:
    """Each distinct (path, offset, requested) that is read, and how often."""
    return trace.where(is_read()).groupBy("path", "offset", F.col("requested").alias("length")).agg(F.count("*").alias("events"))


def hot_ranges(trace: DataFrame, k: int = 20) -> DataFrame:
    """The k ranges read most; ties by the file's first occurrence, then offset and length."""
    ranked = read_ranges(trace).join(file_ids(trace), "path")
    return ranked.orderBy(F.col("events").desc(), "file_id", "offset", "length").limit(k)


def adjacency(trace: DataFrame) -> DataFrame:
    """The reads, each with sequential: it begins where its stream's last read ended.

    A stream is a session's worker on a path. A read that failed or returned nothing ends where it
    began, so that its repetition is sequential.
    """
    stream = Window.partitionBy("session", "worker", "path").orderBy("seq")
    last = F.lag(F.col("offset") + F.col("returned")).over(stream)
    return trace.where(is_read()).withColumn("sequential", F.coalesce(last == F.col("offset"), F.lit(False)))


def summary(trace: DataFrame) -> DataFrame:
    """One row: totals, ratios and percentiles of the whole trace. Totals that overflow are errors."""
    read, write = is_read(), F.col("op") == "write"
    hits, misses = F.count_if(read & (F.col("cache") == "hit")), F.count_if(read & F.col("cache").isin("miss", "mixed"))
    totals = trace.agg(
        F.count("*").alias("events"),
        F.count_distinct("session").alias("sessions"),
        F.count_if(read).alias("read_operations"),
        F.count_if(write).alias("write_operations"),
        F.coalesce(F.sum(F.when(read, F.col("returned"))), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum(F.when(write, F.col("returned"))), F.lit(0)).alias("write_bytes"),
        hits.alias("hits"),
        misses.alias("misses"),
    )
    unique = read_ranges(trace).agg(F.count("*").alias("unique_read_ranges"))
    sequential = adjacency(trace).agg(F.count_if("sequential").alias("sequential"))
    ranks = nearest_ranks(trace, [], "latency_ns")
    # four one-row tables
    both = totals.join(unique, F.lit(True), "left").join(sequential, F.lit(True), "left").join(ranks, F.lit(True), "left")
    reads = F.col("read_operations")
    return both.select(
        "events", "sessions", "read_operations", "write_operations", "read_bytes", "write_bytes", "unique_read_ranges",
        (100.0 * ratio(F.col("sequential"), reads)).alias("sequential_read_percentage"),
        ratio(reads - F.col("unique_read_ranges"), reads).alias("reread_ratio"),
        ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("cache_hit_ratio"),
        ratio(F.col("misses"), F.col("hits") + F.col("misses")).alias("cache_miss_ratio"),
        *(F.coalesce(p, F.lit(0).cast("long")).alias(p) for p in ("p50", "p95", "p99")),
    )


def admitted(trace: DataFrame) -> DataFrame:
    """The trace with admitted: no text field is longer than its bound, which is in bytes."""
    fits = F.lit(True)
    for name, most in BOUNDS.items():
        fits = fits & (F.octet_length(name) <= most)
    return trace.withColumn("admitted", F.coalesce(fits, F.lit(False)))


def accounting(trace: DataFrame, queue: int, fails_at: int | None = None) -> DataFrame:
    """What a bounded queue that is emptied after every ``queue`` arrivals would write and drop.

    Of the events of one period, what does not fit or is over-long is dropped and counted; seen =
    written + dropped always. ``fails_at`` is the seq from which on the writer fails: its first kept
    event is the one error, and from there on all are dropped. queue_high_watermark is the most that
    stood in the queue in the period.
    """
    period = F.floor(F.col("seq") / (2 * queue))
    place = F.row_number().over(Window.partitionBy("period").orderBy("seq"))
    arrived = admitted(trace).withColumn("period", period).withColumn("queued", F.col("admitted") & (place <= queue))
    works = F.lit(True) if fails_at is None else F.col("seq") < fails_at
    first = None if fails_at is None else arrived.where(F.col("queued") & ~works).agg(F.min("seq")).first()[0]
    kept = F.col("queued") & works
    failed = F.col("seq") == first if first is not None else F.lit(False)
    out = arrived.groupBy("period").agg(F.count("*").alias("seen"), F.count_if(kept).alias("written"), F.count_if(~kept).alias("dropped"), F.count_if("queued").alias("queue_high_watermark"), F.count_if(failed).alias("writer_errors"))
    return out.withColumn("conserved", F.col("seen") == F.col("written") + F.col("dropped"))
