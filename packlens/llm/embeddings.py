"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors at cosine c are at distance d = sqrt(2 - 2c); the difference of their projections on a
random Gaussian direction is normal with deviation d. A first projection, sorted and cut into slabs,
says which blocks of vectors can meet in its window at all. In a task that holds two such blocks, each of
SORTED further projections of the one block is sorted; a vector of the other finds its window there by
search, and what lies in the window gets one collision. Pairs with too few collisions go; for the rest
the windows of further projections are tried, at two more checkpoints. What is left is verified by its
cosine in double precision. The least count at a checkpoint is the largest that a pair at cosine c
exactly reaches with a probability such that all checkpoints together miss 1 - RECALL, so farther pairs
drop out early and closer ones pass with a higher probability.

What leaves a task is a link count a vector and a forest of links, at most one edge a vector: a cluster
of k vectors never becomes k * k rows. Equal vectors are one vector with a multiplicity before any of that.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, join_unique, prepare
from .components import components

SEED, RECALL, BLOCK = 7, 0.999, 8192
#: How many projections are sorted, and after how many the counts are looked at.
SORTED, CHECKPOINTS = 12, (12, 20, 32)
#: Windows in deviations of the difference at the threshold: of the first projection and of the others.
FIRST, REST = 3.3, 1.5
#: Links of a task are turned into a forest whenever there are so many.
MOST_EDGES = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, not zero, of at least one component, all of them finite numbers."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & good & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    """Rows scaled to length one in double precision, whatever their range."""
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(size: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, n))


def least_count(n: int, p: float, recall: float) -> int:
    """The largest count that n trials of probability p reach with probability ``recall`` at least."""
    tail, at = 0.0, n
    while at > 0:
        tail += comb(n, at) * p**at * (1 - p) ** (n - at)
        if tail >= recall:
            break
        at -= 1
    return at


def least_counts() -> list[int]:
    """The least count at each checkpoint."""
    p = erf(REST / sqrt(2))
    return [least_count(n, p, 1 - (1 - RECALL) / len(CHECKPOINTS)) for n in CHECKPOINTS]


def _distance(cosine: float) -> float:
    return sqrt(max(2 - 2 * cosine, 1e-6))


def _slab(cosine: float, seed: int):
    wide = FIRST * _distance(cosine) / 2

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes, slabs = pc.list_value_length(column).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                slabs[at] = np.floor((unit(column.take(pa.array(at)).to_pylist()) @ directions(int(size), 1, seed))[:, 0] / wide)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slabs, pa.int32())], names=[*batch.schema.names, "slab"])

    return run


class Windows:
    """A block's projections, those that are sorted in order, and the pairs that collide often enough."""

    def __init__(self, x: np.ndarray, cosine: float, seed: int):
        self.x, self.cosine, self.half, self.least = x, cosine, REST * _distance(cosine), least_counts()
        self.directions = directions(x.shape[1], CHECKPOINTS[-1], seed)
        self.values = x @ self.directions
        self.order = [np.argsort(self.values[:, i], kind="stable") for i in range(SORTED)]
        self.sorted = [self.values[o, i] for i, o in enumerate(self.order)]
        self.met = 0

    def linked(self, queries: np.ndarray):
        """For each query, the rows of the block at the cosine or nearer, among those that collide with it."""
        values = queries @ self.directions
        low = [np.searchsorted(v, values[:, i] - self.half) for i, v in enumerate(self.sorted)]
        high = [np.searchsorted(v, values[:, i] + self.half, side="right") for i, v in enumerate(self.sorted)]
        for k in range(len(queries)):
            count = np.zeros(len(self.x), dtype=np.uint8)
            for i, order in enumerate(self.order):
                count[order[low[i][k] : high[i][k]]] += 1
            at = np.flatnonzero(count >= self.least[0])
            count = count[at]
            for start, stop, least in zip(CHECKPOINTS, CHECKPOINTS[1:], self.least[1:]):
                count = count + (np.abs(self.values[at, start:stop] - values[k, start:stop]) <= self.half).sum(axis=1)
                at, count = at[count >= least], count[count >= least]
            self.met += len(at)
            yield at[self.x[at] @ queries[k] >= self.cosine]


def _collide(cosine: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = unit(table.column("vector").to_pylist())
        same = (side == 1).all()  # a block with itself; else the sides are 0 and 2
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        if len(left) > len(right):
            left, right = right, left
        links = np.zeros(len(node), dtype=np.int64)
        label = np.arange(len(node))
        met: list[tuple[np.ndarray, np.ndarray]] = []

        def join() -> None:
            nonlocal label
            i, j = np.concatenate([a for a, _ in met]), np.concatenate([b for _, b in met])
            met.clear()
            while True:  # the least number reachable by these links
                low, old = np.minimum(label[i], label[j]), label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                np.minimum.at(label, old[i], low)
                np.minimum.at(label, old[j], low)
                label = label[label]
                if (label == old).all():
                    return

        held = 0
        if len(left) and len(right):
            for k, at in enumerate(Windows(x[right], cosine, seed + 1).linked(x[left])):
                at = at[at > k] if same else at
                if not len(at):
                    continue
                i, j = left[k], right[at]
                links[i] += copies[j].sum()
                links[j] += copies[i]
                met.append((np.full(len(j), i), j))
                held += len(j)
                if held > MOST_EDGES:
                    join()
                    held = 0
        if met:
            join()
        some = (links > 0) | (label != np.arange(len(node)))
        return pa.table({"node": pa.array(node[some]), "n": pa.array(links[some]), "root": pa.array(node[label][some])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row a vector: id, n_links, component (least id of its class), kept (it has that id).

    Linked are vectors whose cosine is ``cosine`` at least; each such pair is found with probability
    RECALL or more (times that of the first window), none below is linked. Rows with unusable vectors
    (see usable) and vectors of other lengths link with nothing. Repeated rows count as vectors of
    their own and link with one another. A null id counts as larger than any other. Other columns are
    ignored. An empty table gives an empty result. Vectors are told apart by 128 bits of hashes.
    """
    spark = vectors.sparkSession
    prepare(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    good = usable(F.col("vector"))
    marked = source.withColumn("h1", F.when(good, F.xxhash64("vector"))).withColumn("h2", F.when(good, F.xxhash64(F.lit(1), "vector")))
    rows = Saved(marked.select("id", "h1", "h2"), "vectors").df
    distinct = marked.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    kind = marked.schema["vector"].dataType.simpleString()
    # nodes are numbered once, in the table that is written
    numbered = distinct.withColumn("node", F.monotonically_increasing_id())
    placed = Saved(numbered.mapInArrow(_slab(cosine, seed), f"h1 long, h2 long, rep long, copies long, vector {kind}, node long, slab int"), "slabs").df
    placed = placed.withColumn("size", F.size("vector"))
    slabs = placed.groupBy("size", "slab").agg(F.count("*").alias("many"), F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    cut = slabs.select("size", "slab", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    mate = cut.select("size", F.col("slab").alias("slab2"), F.col("cut").alias("cut2"))
    pairs = cut.join(mate, "size").where("slab2 - slab between 0 and 2 and (slab2 > slab or cut2 >= cut)")
    pair = F.xxhash64("size", "slab", "cut", "slab2", "cut2").alias("pair")
    one = F.when((F.col("slab") == F.col("slab2")) & (F.col("cut") == F.col("cut2")), 1).otherwise(0).alias("side")
    sides = pairs.select("size", "slab", "cut", pair, one).unionAll(pairs.where("slab2 <> slab or cut2 <> cut").select("size", F.col("slab2").alias("slab"), F.col("cut2").alias("cut"), pair, F.lit(2).alias("side")))
    spread = join_unique(placed, slabs, ["size", "slab"], "many").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("cuts")).cast("int"))
    found = Saved(spread.join(sides, ["size", "slab", "cut"]).select("pair", "side", "node", "copies", "vector").groupBy("pair").applyInArrow(_collide(cosine, seed), "node long, n long, root long"), "found").df
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = placed.select("node", "h1", "h2", "rep", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("nodes"))
    named = join_unique(known, least, ["root"], "nodes").select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = join_unique(rows.where("h1 is not null"), named, ["h1", "h2"], "copies", weights=placed).select("id", "n_links", "component")
    out = out.unionByName(rows.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; see near_duplicates."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
