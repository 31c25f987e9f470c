"""Byte ranges of files: which chunks a read meets, and the bytes it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import chunk_ordinals
from .numbering import numbered

MOST_READ = 16 << 20
#: Ranges meet by spans of so many bytes.
SPAN = 1 << 20


def clipped(reads: DataFrame, files: DataFrame) -> DataFrame:
    """Reads (seq, path, offset, len) with size, end (not behind the file's) and returned; a path that is
    no file's is an error."""
    checked = reads.join(files.select("path", F.col("size").alias("size")), "path", "left")
    size = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "path"))).otherwise(F.col("size"))
    end = F.least(F.col("offset") + F.col("len"), F.col("size"))
    return checked.withColumn("size", size).withColumn("end", end).withColumn("returned", F.greatest(F.lit(0).cast("long"), F.col("end") - F.col("offset")))


def resolve(reads: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a read and chunk it meets: with start and stop of the part wanted, inside the chunk.

    See meeting; for chunks of one size use resolve_fixed, which has no residual. Empty reads and those
    behind the end meet nothing.
    """
    c = chunks.select("path", "ordinal", F.col("offset").alias("chunk_offset"), "raw_size", *(x for x in ("hash", "data") if x in chunks.columns))
    r = clipped(reads, files).where("len > 0 and end > offset")
    return _parts(meeting(r, ("offset", "end"), c.withColumn("chunk_end", F.col("chunk_offset") + F.col("raw_size")), ("chunk_offset", "chunk_end")).drop("chunk_end"))


def meeting(left: DataFrame, a: tuple[str, str], right: DataFrame, b: tuple[str, str], on: str = "path", span: int = SPAN) -> DataFrame:
    """The pairs of rows with the same ``on`` whose ranges [start, end) overlap, each once.

    Both sides are dealt out by the spans of ``span`` that their ranges touch, and joined on path and
    span, so that a file with many reads and many chunks is many keys. A pair that has several spans in
    common is kept at the first of them. Empty ranges meet nothing.
    """
    touched = lambda x: F.explode(F.sequence(F.floor(F.col(x[0]) / span), F.floor((F.col(x[1]) - 1) / span)))
    l, r = left.where(F.col(a[1]) > F.col(a[0])).withColumn("__span", touched(a)), right.where(F.col(b[1]) > F.col(b[0])).withColumn("__span", touched(b))
    first = F.floor(F.greatest(a[0], b[0]) / span)
    return l.join(r, [on, "__span"]).where((F.col(b[0]) < F.col(a[1])) & (F.col(b[1]) > F.col(a[0])) & (F.col("__span") == first)).drop("__span")


def resolve_fixed(reads: DataFrame, files: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """resolve for fixed-size chunks: ordinals are computed, the join is on path and ordinal alone."""
    r = clipped(reads, files).withColumn("ordinal", F.explode(chunk_ordinals(F.col("offset"), F.col("end"), size)))
    c = chunks.select("path", "ordinal", F.col("offset").alias("chunk_offset"), "raw_size", *(x for x in ("hash", "data") if x in chunks.columns))
    return _parts(r.join(c, ["path", "ordinal"]))


def _parts(met: DataFrame) -> DataFrame:
    start = F.greatest(F.lit(0).cast("long"), F.col("offset") - F.col("chunk_offset"))
    stop = F.least(F.col("end") - F.col("chunk_offset"), F.col("raw_size"))
    return met.withColumn("start", start).withColumn("stop", stop)


def read_ranges(resolved: DataFrame) -> DataFrame:
    """seq, path, text: the bytes (or characters) of each read, from its parts in order. A read of more
    than 16 MiB is an error."""
    bounded = F.when(F.col("returned") > MOST_READ, F.raise_error(F.lit("read too large"))).otherwise(F.col("data"))
    part = F.substring(bounded, (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    parts = resolved.groupBy("seq", "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("data")))).alias("parts"))
    return parts.select("seq", "path", F.array_join(F.transform("parts", lambda x: x["data"]), "").alias("text"))


#: Lengths that a planned workload takes in turn.
LENGTHS = (4096, 65536, 1048576)


def planned_reads(files: DataFrame, count: int, seed: str = "plan", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """seq, path, offset, len: a workload that the seed decides. Each read takes the file and the place in
    it that hashes of the seed and its number give, and the lengths in turn, cut to the file's size.
    Empty files are not read; without any other file it is an error, as are counts beyond 1 to 10,000."""
    if not 1 <= count <= 10_000:
        raise ValueError("1 to 10,000 reads")
    some = numbered(files.where("size > 0").select("path", "size"), ["path"], "nth", 0)
    many = some.count()
    if not many:
        raise ValueError("no file with content")
    drawn = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), F.col("seq").cast("string"))), 1, 12), 16, 10).cast("long")
    asked = files.sparkSession.range(count).select(F.col("id").alias("seq")).withColumn("nth", drawn("file") % many).withColumn("length", F.element_at(F.array(*(F.lit(n).cast("long") for n in lengths)), (F.col("seq") % len(lengths) + 1).cast("int")))
    read = asked.join(some, "nth").withColumn("len", F.least("length", "size"))
    return read.select("seq", "path", (drawn("place") % (F.col("size") - F.col("len") + 1)).alias("offset"), "len")


def synthetic_reads(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The workload on the largest file (ties: the last path): its first 128 chunks, then 128 rounds of
    its first four chunks and one more, in turn. seq is the order."""
    largest = files.agg(F.max_by("path", F.struct("size", "path")).alias("path"))
    own = chunks.join(largest, "path").select("path", "ordinal", "offset", "raw_size")
    count = own.agg(F.count("*").alias("n"))
    scan = own.where("ordinal < 128").select("path", F.col("ordinal").alias("seq"), "offset", F.least(F.lit(65536), "raw_size").alias("len"))
    rounds = own.sparkSession.range(128).withColumnRenamed("id", "cycle")
    hot = rounds.join(own.where("ordinal < 4"), F.lit(True)).select("path", (F.lit(1000) + F.col("cycle") * 10 + F.col("ordinal")).alias("seq"), "offset", F.least(F.lit(4096), "raw_size").alias("len"))
    turn = rounds.join(count, F.lit(True)).withColumn("ordinal", F.col("cycle") % F.col("n")).join(own, "ordinal")
    stream = turn.select("path", (F.lit(1000) + F.col("cycle") * 10 + 4).alias("seq"), "offset", F.least(F.lit(4096), "raw_size").alias("len"))
    return scan.unionByName(hot).unionByName(stream)
