"""Comparisons of inventories, reads, stores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventories(expected: DataFrame, actual: DataFrame, columns: tuple[str, ...] = ("kind", "size", "sha256"), key: str = "path") -> DataFrame:
    """key, state of every entry that is not the same on both sides: missing, changed or extra.
    Unknown values are equal to unknown values only."""
    left = expected.select(key, F.struct(*columns).alias("e"))
    right = actual.select(key, F.struct(*columns).alias("a"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~same, "changed")
    return left.join(right, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def equal(a: DataFrame, b: DataFrame, columns: tuple[str, ...], key: str = "path") -> bool:
    return inventories(a, b, columns, key).isEmpty()


def sidecars(differences: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Of what is extra, the metadata companions (._name beside name, both known and expected) apart from
    the unexpected: path, companion, unexpected."""
    from ..functions.paths import base_name, parent

    extra = differences.where("state = 'extra'")
    name, above = base_name(F.col("path")), parent(F.col("path"))
    plain = F.when(name.rlike(r"^\._."), F.concat(F.when(above == "", "").otherwise(F.concat(above, F.lit("/"))), F.substring(name, 3, 4096)))
    both = expected.select("path").join(actual.select("path"), "path", "left_semi").select(F.col("path").alias("companion")).distinct()
    return extra.withColumn("companion", plain).join(both.withColumn("known", F.lit(True)), "companion", "left").select("path", F.when(F.col("known"), F.col("companion")).alias("companion"), F.coalesce(~F.col("known"), F.lit(True)).alias("unexpected"))


def differing_reads(left: DataFrame, right: DataFrame, value: str = "digest", key: tuple[str, ...] = ("path", "offset", "len")) -> DataFrame:
    """Reads made on both sides whose results are not the same."""
    joined = left.select(*key, F.col(value).alias("l")).join(right.select(*key, F.col(value).alias("r")), list(key))
    return joined.where(~F.col("l").eqNullSafe(F.col("r"))).select(*key)


def disagreeing(runs: DataFrame, group: str, digest: str = "digest") -> DataFrame:
    """Groups (trials, queries) whose runs do not all have one digest."""
    return runs.groupBy(group).agg(F.count_distinct(digest).alias("digests")).where("digests > 1")
