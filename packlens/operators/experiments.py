"""Summaries of repeated trials and of read benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trace import nearest_ranks, ratio

MIB = 1 << 20


def trial_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median, population variance, least, most and number of a value; all null but the number where any
    value is missing, since an unknown one makes them unknown."""
    known = F.count(value) == F.count("*")
    only = lambda c: F.when(known, c)
    return rows.groupBy(by).agg(
        only(F.expr(f"percentile({value}, 0.5)")).alias("median"), only(F.var_pop(value)).alias("variance"), only(F.min(value)).alias("least"), only(F.max(value)).alias("most"),
        F.when(known, F.count("*")).alias("trials"))


def interpolated(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles between neighbours, unlike nearest_ranks."""
    return rows.groupBy(by).agg(*(F.expr(f"percentile({value}, {p})").alias(f"p{round(p * 100)}") for p in points))


def workload_table(rows: DataFrame, by: str) -> DataFrame:
    """Operations, bytes, exact latency percentiles (ns), MiB/s. rows: bytes, ns."""
    seconds = F.sum("ns") / 1e9
    totals = rows.groupBy(by).agg(F.count("*").alias("operations"), F.sum("bytes").alias("bytes"), ratio(F.sum("bytes") / MIB, seconds).alias("mib_s"))
    ranks = nearest_ranks(rows, [by], "ns").withColumnRenamed(by, "__by")
    joined = totals.join(ranks, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.select(by, "operations", "bytes", *(F.coalesce(p, F.lit(0).cast("long")).alias(p) for p in ("p50", "p95", "p99")), "mib_s")


def amplification(loaded: Column, returned: Column) -> Column:
    """Bytes loaded for a byte returned; 0 where nothing was returned."""
    return ratio(loaded, returned)


def preloaded_amplification(loaded: Column, requested: Column) -> Column:
    """As above for runs that read everything twice; unknown where nothing was requested."""
    return F.when(requested != 0, loaded / (requested * 2))


def rotated(trials: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """trial, place, mode: each trial runs the modes in an order turned by one more than the last."""
    n = len(modes)
    names = F.array(*map(F.lit, modes))
    placed = trials.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return placed.withColumn("mode", F.element_at(names, ((F.col("trial") + F.col("place")) % n + 1).cast("int")))


def nth_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
