"""Numbers and neighbours in a global order, without bringing all rows to one task.

Rows are range-partitioned by the order and sorted within partitions; the result is cut from its
lineage, so that all that follows sees one and the same placing. A row's number is its place in its
partition and the rows before that: one count a partition is all that reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", first: int = 1) -> DataFrame:
    """df with each row's number in the order of ``order``, from ``first`` on; ties in any order."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=first)))
    before = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0))
    offsets = placed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__part long, __start long") if len(starts) > 64 else None
    if offsets is None:
        return placed.withColumn(name, (F.element_at(before, part) + F.col("__place").bitwiseAND(_LOCAL)).cast("long")).drop("__place")
    joined = placed.withColumn("__part", part).join(offsets, "__part")  # one row a partition
    return joined.withColumn(name, F.col("__start") + F.col("__place").bitwiseAND(_LOCAL)).drop("__place", "__part", "__start")


def with_previous(df: DataFrame, order: list[str | Column], value: str, name: str = "previous") -> DataFrame:
    """df with ``value`` of the row before in the whole order; null for the first."""
    rows = cut(numbered(df, order, "__number"))
    before = rows.select((F.col("__number") + 1).alias("__number"), F.col(value).alias(name))
    return rows.join(before, "__number", "left").drop("__number")
