"""Tiered lookups: each object from the first tier that has it; what is found but wrong is an error of its
own and does not fall through to the next tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(wanted: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """hash, raw_size, status (ok, corrupt, not found), source.

    wanted and tiers have hash and raw_size. Each tier joins only what the ones before did not settle.
    """
    open_, settled = wanted, None
    for name, tier in tiers:
        held = tier.select("hash", F.col("raw_size").alias("held"))
        tried = open_.join(held, "hash", "left")
        status = F.when(F.col("held") == F.col("raw_size"), "ok").otherwise("corrupt")
        done = tried.where("held is not null").select("hash", "raw_size", status.alias("status"), F.lit(name).alias("source"))
        settled = done if settled is None else settled.unionAll(done)
        open_ = tried.where("held is null").select("hash", "raw_size")
    left = open_.select("hash", "raw_size", F.lit("not found").alias("status"), F.lit(None).cast("string").alias("source"))
    return left if settled is None else settled.unionAll(left)


def counters(looked_up: DataFrame, primary: str = "primary-local") -> DataFrame:
    """source, hits, bytes, promotions, promotion_bytes: what a lower tier gave is copied to the first."""
    away = F.col("source") != primary
    return looked_up.where("status = 'ok'").groupBy("source").agg(
        F.count("*").alias("hits"), F.sum("raw_size").alias("bytes"), F.count_if(away).alias("promotions"), F.coalesce(F.sum(F.when(away, F.col("raw_size"))), F.lit(0)).alias("promotion_bytes"))
