"""Sequential-access detection per path, decayed file heat, and the policy derived from them.

Elapsed times never go below zero: a clock that steps back counts as no gap and breaks no sequence.
Order is that of arrival (seq).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .numbering import numbered
from .ranges import meeting
from .trace import hot_files, ratio

PRIORITY_MOST, FILE_MOST, HEAT_MOST, TRACKED = 2048, 1024, 1024, 4096


@dataclass(frozen=True)
class Policy:
    """Parameters of prefetching and eviction; violations() lists what is out of range."""

    cache_bytes: int | None = None
    eviction: str = "decaying-hotness"
    decay_accesses: int = 64
    enabled: bool = True
    sequential_reads: int = 3
    max_chunks: int = 2
    budget_bytes: int = 8 << 20
    queue_depth: int = 32
    ttl_ms: int = 500
    files: dict[str, int] = field(default_factory=dict)

    def violations(self) -> list[str]:
        from ..functions.paths import is_valid_path

        ranges = {"decay_accesses": (1, 1_000_000), "sequential_reads": (2, 32), "max_chunks": (1, 8), "budget_bytes": (0, 128 << 20), "queue_depth": (1, 256), "ttl_ms": (1, 30_000)}
        found = [name for name, (low, high) in ranges.items() if not low <= getattr(self, name) <= high]
        found += ["cache_bytes"] * (self.cache_bytes is not None and not 0 <= self.cache_bytes <= 4 << 30)
        found += ["eviction"] * (self.eviction not in ("lru", "decaying-hotness"))
        bad = len(self.files) > TRACKED or any(not is_valid_path(p) or not 1 <= n <= FILE_MOST for p, n in self.files.items())
        return found + ["files"] * bad


def good_reads(trace: DataFrame) -> DataFrame:
    return trace.where("op = 'read' and success and returned > 0")


def decayed(score: Column, elapsed: Column, interval: int) -> Column:
    """score halved once for each whole interval, at most 31 times."""
    return F.call_function("shiftright", score.cast("int"), F.least(F.lit(31), F.floor(elapsed / max(1, interval))).cast("int"))


def sequences(reads: DataFrame, ttl_ms: int, least: int = 3) -> DataFrame:
    """Each read with run (which run of its path), confidence, forward_bytes, sequential.

    A read goes on with its path's run if it starts behind the last start and not behind the last end,
    ends behind the last end, and comes within ttl_ms. forward_bytes are the bytes the run has covered.
    """
    by_path = Window.partitionBy("path").orderBy("seq")
    at, end = F.expr("ts_ns div 1000000"), F.col("offset") + F.col("returned")
    r = reads.withColumn("end", end).withColumn("at_ms", at)
    last = {c: F.lag(c).over(by_path) for c in ("offset", "end", "at_ms")}
    goes_on = (F.col("offset") > last["offset"]) & (F.col("offset") <= last["end"]) & (F.col("end") > last["end"]) & (F.greatest(F.lit(0), F.col("at_ms") - last["at_ms"]) <= ttl_ms)
    r = r.withColumn("on", F.coalesce(goes_on, F.lit(False))).withColumn("gain", F.when(F.col("on"), F.col("end") - last["end"]).otherwise(F.col("returned")))
    r = r.withColumn("run", F.sum((~F.col("on")).cast("long")).over(by_path))
    in_run = Window.partitionBy("path", "run").orderBy("seq")
    r = r.withColumn("confidence", F.row_number().over(in_run).cast("long")).withColumn("forward_bytes", F.sum("gain").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumn("sequential", F.col("confidence") >= least).drop("on", "gain", "at_ms")


def heat(reads: DataFrame, interval: int = 64, span: int = 1 << 20) -> DataFrame:
    """path, heat, epoch: each path's score after its last read: min(1024, decayed score + 1).

    The clock is the number of the read among all reads (see numbering). A path's reads are folded in
    spans of ``span`` numbers, all at once: a span becomes what it makes of each score that may come
    into it, of which there are HEAT_MOST + 1. A path's spans are then applied one after the other.
    """
    ship(reads.sparkSession)
    clock = numbered(reads.select("path", "seq"), ["seq"], "epoch").select("path", "epoch", F.floor(F.col("epoch") / span).alias("span"))
    spans = clock.groupBy("path", "span").applyInArrow(_span_of_heat(interval), "path string, first long, last long, becomes array<short>")
    folded = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", "last", "becomes"))).alias("spans"))
    entering = lambda acc, x: F.when(acc["last"].isNull(), 0).otherwise(decayed(acc["score"], x["first"] - acc["last"], interval))
    step = lambda acc, x: F.struct(F.get(x["becomes"], entering(acc, x)).cast("int").alias("score"), x["last"].alias("last"))
    none = F.struct(F.lit(0).alias("score"), F.lit(None).cast("long").alias("last"))
    return folded.select("path", F.aggregate("spans", none, step).alias("x")).select("path", F.col("x.score").cast("long").alias("heat"), F.col("x.last").alias("epoch"))


def _span_of_heat(interval: int):
    """Of a path's reads in a span: the first, the last, and the score after the last for every decayed
    score before the first."""

    def run(table: pa.Table) -> pa.Table:
        epochs = np.sort(table.column("epoch").to_numpy())
        shifts = np.minimum(31, np.diff(epochs) // max(1, interval))
        score = np.minimum(HEAT_MOST, np.arange(HEAT_MOST + 1) + 1)
        for i, shift in enumerate(shifts.tolist()):
            if score[0] == score[-1]:  # whatever came in, it is one score by now
                now = int(score[0])
                for later in shifts[i:].tolist():
                    now = min(HEAT_MOST, (now >> later) + 1)
                score = np.full(HEAT_MOST + 1, now)
                break
            score = np.minimum(HEAT_MOST, (score >> shift) + 1)
        columns = {"path": table.column("path").slice(0, 1), "first": pa.array([int(epochs[0])]), "last": pa.array([int(epochs[-1])]), "becomes": pa.array([score.astype(np.int16)], pa.list_(pa.int16()))}
        return pa.table(columns)

    return run


def priorities(trace: DataFrame) -> DataFrame:
    """path, priority of the hottest files: their events, within 1..1024."""
    return hot_files(trace).select("path", F.least(F.lit(FILE_MOST), F.greatest(F.lit(1), F.col("events"))).cast("long").alias("priority"))


def read_priority(heat_score: Column, file_priority: Column) -> Column:
    return F.least(F.lit(PRIORITY_MOST), heat_score + F.coalesce(file_priority, F.lit(0)))


def prefetch_enabled(trace: DataFrame, ttl_ms: int, least: int = 3, share: float = 0.2) -> DataFrame:
    """One row: reads, sequential, enabled (their ratio reaches ``share``)."""
    found = sequences(good_reads(trace), ttl_ms, least).agg(F.count("*").alias("reads"), F.count_if("sequential").alias("sequential"))
    return found.withColumn("enabled", (F.col("reads") > 0) & (ratio(F.col("sequential"), F.col("reads")) >= share))


def optimize(trace: DataFrame, ttl_ms: int = 500) -> Policy:
    """The policy that a trace suggests: initial priorities and whether to prefetch."""
    files = {r["path"]: r["priority"] for r in priorities(trace).collect()}  # 20 rows at most
    return Policy(files=files, enabled=prefetch_enabled(trace, ttl_ms).first()["enabled"], ttl_ms=ttl_ms)


def look_ahead(reads: DataFrame, chunks: DataFrame, most: int = 2) -> DataFrame:
    """For sequential reads that covered at least their last chunk: the next ``most`` chunks to prefetch.

    chunks: path, ordinal, offset, raw_size. One row a read and chunk.
    """
    r = reads.where("sequential").select("path", "seq", "forward_bytes", F.col("offset").alias("start"), (F.col("offset") + F.col("returned")).alias("stop"))
    c = chunks.select("path", "ordinal", "raw_size", F.col("offset").alias("begin"), (F.col("offset") + F.col("raw_size")).alias("end"))
    hit = meeting(r, ("start", "stop"), c, ("begin", "end"))
    last = hit.groupBy("path", "seq", "forward_bytes").agg(F.max_by("raw_size", "ordinal").alias("size"), F.max("ordinal").alias("last")).where("forward_bytes >= size")
    wanted = last.select("path", "seq", F.explode(F.sequence(F.col("last") + 1, F.col("last") + most)).alias("ordinal"))
    return wanted.join(chunks, ["path", "ordinal"]).select("seq", "path", "ordinal", F.col("offset").alias("chunk_offset"), F.col("raw_size").alias("chunk_size"))
