"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Vectors are dealt out by their length into bands of a factor BAND, and each band by a hash into blocks
of at most about BLOCK rows; each block has TREES sorted arrays of BITS-bit hash strings, the signs of
random projections. A query descends each array to its longest prefix match and then ascends in all of them
at once, one bit at a time, until the rows that share a prefix with it in some tree are SHARE of the
block and MORE times the rows asked for; only these are its candidates there and only their products
are computed. The best of all blocks are its answer. For inner products, rows get one more component
that brings all of a block to the length of its longest; queries get 0 there, so that the angle
orders rows as the product does. In a band that component is small, so that it hides little of the angle.

Rows of random directions have neighbours hardly nearer than the rest: what SHARE and TREES give was
measured on such data. Every row is in the index; nothing is sampled. Blocks are built anew for each
chunk of CHUNK queries, which costs a small part of what a chunk's search does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, join_unique, parts, prepare
from .embeddings import usable

TREES, BITS, SHARE, MORE, SEED, BAND, BLOCK, CHUNK = 256, 32, 0.27, 10, 11, 1.1, 16384, 8192
#: Queries that descend together.
TOGETHER = 256


def _planes(size: int, bits: int, seed: list[int]) -> np.ndarray:
    """Random directions, at right angles to one another as far as there is room: their signs repeat one
    another less than those of independent ones."""
    raw = np.random.Generator(np.random.PCG64(seed)).standard_normal((size, bits))
    return np.concatenate([np.linalg.qr(raw[:, a : a + size])[0] for a in range(0, bits, size)], axis=1).astype(np.float32)


class Forest:
    """The index of one block."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.x, self.bits, self.trees = x, bits, trees
        self.planes = np.concatenate([_planes(x.shape[1] + 1, bits, [seed, t]) for t in range(trees)], axis=1)
        scale = max(np.abs(x).max(), 1e-300)
        short = ((x / scale) ** 2).sum(axis=1)
        code = self._hash(np.column_stack((x / scale, np.sqrt(short.max() - short))))
        self.order = [np.argsort(code[t], kind="stable") for t in range(trees)]
        self.sorted = [code[t, o].astype(np.int64) for t, o in enumerate(self.order)]

    def _hash(self, x: np.ndarray) -> np.ndarray:
        """A row a tree: the first ``bits`` bits of 32."""
        out = np.empty((self.trees, len(x)), dtype=np.uint32)
        x = x.astype(np.float32)
        for a in range(0, len(x), 1024):
            signs = np.zeros((len(x[a : a + 1024]), self.trees, 32), dtype=bool)
            signs[:, :, : self.bits] = (x[a : a + 1024] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[:, a : a + 1024] = np.packbits(signs, axis=2).view(">u4")[:, :, 0].T
        return out

    def _ranges(self, code: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree (row), where the prefixes of the queries (column) less ``drop`` bits begin and end."""
        first = (code >> drop) << drop
        last = first + (1 << drop)
        low = [np.searchsorted(s, f) for s, f in zip(self.sorted, first)]
        return np.array(low), np.array([np.searchsorted(s, f) for s, f in zip(self.sorted, last)])

    def candidates(self, q: np.ndarray, need: int):
        """For each query, the rows met when the ascent ends: ``need`` of them at least, or all."""
        need = min(need, len(self.x))
        code = self._hash(np.column_stack((q / np.abs(q).max(axis=1, keepdims=True), np.zeros(len(q))))).astype(np.int64)
        # what the trees hold together grows with every bit that is dropped: the first level where it should do, by halving
        n, lowest = len(self.x), 32 - self.bits
        least, most = np.full(len(q), lowest), np.full(len(q), 32)
        while (least < most).any():
            middle = (least + most) // 2
            low, high = self._ranges(code, middle)
            enough = n * -np.expm1(-(high - low).sum(axis=0) / n) >= need
            least, most = np.where(enough, least, middle + 1), np.where(enough, middle, most)
        levels = [self._ranges(code, np.clip(least + step, lowest, 32)) for step in (-1, 0, 1)]
        for k in range(len(q)):
            mask, level = np.zeros(n, dtype=bool), int(least[k]) - 1
            for step in range(32):
                low, high = (x[:, k] for x in levels[step]) if step < 3 else (x[:, 0] for x in self._ranges(code[:, k : k + 1], np.array([min(32, level)])))
                for t, (a, b) in enumerate(zip(low.tolist(), high.tolist())):  # in all trees below, then tree by tree
                    mask[self.order[t][a:b]] = True
                    if step and t % 16 == 15 and np.count_nonzero(mask) >= need:
                        break
                level += 1
                if np.count_nonzero(mask) >= need:
                    break
            yield np.flatnonzero(mask)


def _search(k: int, share: float, more: int, trees: int, bits: int, seed: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            ids, x = rows.column("id").to_numpy(), np.array(rows.column("vector").to_pylist(), dtype=np.float64)
            forest = Forest(x, trees, bits, seed)
            need = int(np.ceil(share * len(x))) + more * k
            keys, own, q = queries.column("key").to_numpy(), queries.column("id").to_numpy(), np.array(queries.column("vector").to_pylist(), dtype=np.float64)
            for a in range(0, len(q), TOGETHER):
                part = q[a : a + TOGETHER]
                for i, at in enumerate(forest.candidates(part, need)):
                    at = at[ids[at] != own[a + i]]
                    if len(at) > k:
                        near = x[at] @ part[i]
                        least = np.partition(near, len(at) - k)[len(at) - k]
                        at = at[near >= least - 1e-9 * max(1.0, abs(least))]
                    exact = (x[at] * part[i]).sum(axis=1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out[0].append(np.full(len(best), keys[a + i]))
                    out[1].append(np.full(len(best), own[a + i]))
                    out[2].append(ids[at[best]])
                    out[3].append(exact[best])
        flat = [np.concatenate(c) if c else np.zeros(0, np.float64 if i == 3 else np.int64) for i, c in enumerate(out)]
        return pa.table({"key": pa.array(flat[0], pa.int64()), "query_id": pa.array(flat[1], pa.int64()), "vec_id": pa.array(flat[2], pa.int64()), "score": pa.array(flat[3], pa.float64())})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, more: int = MORE, trees: int = TREES, bits: int = BITS, block: int = BLOCK, chunk: int = CHUNK, seed: int = SEED
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product among its candidates.

    ``share`` 1.0 makes the search exact. Rows and queries whose vector is unusable (null, empty, zero,
    or with null or non-finite components) or whose id is null take no part; vectors of different
    sizes are searched apart. A query's own row is every row of its id. Rows that repeat an id are
    candidates each; a query that repeats both id and vector is answered once. Equal scores go to the
    smaller id. A query with fewer than k candidates in the table gets them all. Other columns are
    ignored. Empty tables give an empty result. Blocks meet queries in chunks of ``chunk``: a stated
    query set against all rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    most = F.array_max(F.transform("vector", F.abs))  # by which vectors are scaled, so that no square is too large or small
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / most) * (v / most)))
    rows = pick(vectors).withColumn("band", F.floor((F.log(length) + F.log(most)) / F.log(F.lit(BAND))).cast("int"))
    asked = pick(queries).withColumn("key", F.xxhash64("id", "vector")).dropDuplicates(["id", "key"])
    chunks = parts(asked.count(), chunk)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(chunks)).cast("int"))
    bands = Saved(rows.groupBy("size", "band").agg(F.count("*").alias("many"), F.ceil(F.count("*") / block).cast("int").alias("cuts")), "bands").df
    cut = F.pmod(F.xxhash64("id", "vector"), F.col("cuts")).cast("int")
    row_side = join_unique(rows, bands, ["size", "band"], "many").withColumn("cut", cut).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    blocks = bands.select("size", "band", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    query_side = asked.join(blocks, "size")
    group = ["size", "band", "cut", "chunk"]
    met = row_side.groupBy(*group).cogroup(query_side.groupBy(*group)).applyInArrow(_search(k, share, more, trees, bits, seed), "key long, query_id long, vec_id long, score double")
    order = Window.partitionBy("key", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return Saved(met, "met").df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
