"""Structured Streaming over access traces: running counts, and sequences with state by path.

Order within a path is that of seq; each micro-batch is sorted by it before its events meet the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trace import admitted, is_read
from ..session import ship


def counts(events: DataFrame) -> DataFrame:
    """Events, reads and bytes read by operation, over a stream or a table; over-long events are dropped."""
    kept = admitted(events).where("admitted")
    return kept.groupBy("op").agg(F.count("*").alias("events"), F.count_if(is_read()).alias("reads"), F.coalesce(F.sum(F.when(is_read(), F.col("returned"))), F.lit(0)).alias("read_bytes"))


def windowed_counts(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events by time window and operation; what comes later than ``late`` is left out. events: ts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "op").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "op", "events")


OBSERVED = "path string, seq long, confidence long, forward_bytes long, sequential boolean"
_STATE = "start long, ended long, at_ms long, confidence long, forward long"


def _observe(ttl_ms: int, least: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, ended, at, confidence, forward = state.get if state.exists else (-1, -1, 0, 0, 0)
        known = state.exists
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, offset, returned, ts in zip(rows["seq"], rows["offset"], rows["returned"], rows["ts_ns"]):
            end, now = offset + returned, ts // 1_000_000
            if known and start < offset <= ended < end and max(0, now - at) <= ttl_ms:
                confidence, forward = confidence + 1, forward + end - ended
            else:
                confidence, forward = 1, returned
            start, ended, at, known = offset, end, now, True
            out.append((key[0], seq, confidence, forward, confidence >= least))
        state.update((int(start), int(ended), int(at), int(confidence), int(forward)))
        state.setTimeoutTimestamp(max(int(at) + ttl_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["path", "seq", "confidence", "forward_bytes", "sequential"])

    return run


def sequences(reads: DataFrame, ttl_ms: int, late: str, least: int = 3) -> DataFrame:
    """The sequence detector on a stream of good reads: state is one row a path.

    A run ends ttl_ms after its last read; once the watermark, which is ``late`` behind the latest event,
    has passed that, nothing can go on with it and its path's state is dropped. So there is state for the
    paths of the last moments only, however many there have been.
    """
    ship(reads.sparkSession)
    timed = reads.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", late)
    return timed.groupBy("path").applyInPandasWithState(_observe(ttl_ms, least), OBSERVED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in ``path``, a new folder that all executors
    share; its checkpoint is there too. A batch that is tried again replaces what it wrote before. In
    complete mode the last batch is the table."""
    spark, schema = stream.sparkSession, stream.schema
    last = -1

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal last
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last = number

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if last < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows/batch={last}" if mode == "complete" else f"{path}/rows").select(*schema.names)


def open_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A driver table, which may be one file or a folder of them, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
