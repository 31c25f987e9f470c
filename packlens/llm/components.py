"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, parts

EDGES_PER_FILE = 250_000


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 32))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node among itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable.

    Both columns are long. Loops and repeated edges are allowed; nulls are dropped. Each round
    writes its edges to the shared folder, so that no lineage grows, and removes the last ones.
    A node with very many neighbours costs one aggregated row on the side that could be skewed.
    """
    now = Saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct(), "edges")
    seen = _digest(now.df)
    while seen[0]:
        new = Saved(_small(_large(now.df).where("a > b").distinct()).distinct(), "edges", parts(seen[0], EDGES_PER_FILE))
        now.drop()
        now, last = new, seen
        seen = _digest(now.df)
        if seen == last:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
