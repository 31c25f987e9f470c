"""What the operators share: the working folder, tables cut from their lineage, batch sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_local, ship

#: Arrow batches for Python workers hold at most so many rows and bytes, whatever a row's size.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: A key with more than one in so many rows is hot; there cannot be more such keys than this.
HOT, SALTS = 10_000, 64
#: Of hashed keys, places for each row of the table, and the most there are.
SIEVE, MOST_PLACES = 4, 1 << 30
_own: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get in this session, and gives them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which every executor can reach.

    Where the setting is absent, a temporary folder serves, but only for a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault("base", f"file://{tempfile.mkdtemp(prefix='packlens-')}")
    path = f"{base.rstrip('/')}/packlens-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own[path] = path
        atexit.register(_quietly, spark, path)
    return path


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"cannot rename {old} to {new}")


class Saved:
    """A table written as Parquet in the shared folder: its lineage is cut, any executor can read it.

    ``files`` is the most files it should have, where its size is known to be small for the number of
    shuffle partitions: each file costs its writer a few calls of the file system.
    """

    def __init__(self, df: DataFrame, label: str = "t", files: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        (df.coalesce(files) if files else df).write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def free(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has: it is longer than any of them."""
    return "_" * max([2, *map(len, columns)]) + name


def join_unique(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where it has none; ``facts`` has each key once.

    ``weight`` says how many of ``rows`` a key has; null means few. A key with more than one in HOT of
    all ``total`` rows would fill a task: there are at most HOT such keys, whatever the size of the
    tables. They alone are broadcast; what is said of them is repeated for SALTS parts of their rows, so
    that no task has more than a small share of any. ``weights`` may give keys and weights more
    cheaply than ``facts``. Keys must not be null in ``facts``.
    """
    most = max((rows.count() if total is None else total) / HOT, 1)
    salt, is_hot = free([*rows.columns, *facts.columns], "salt"), free([*rows.columns, *facts.columns], "hot")
    hot = F.coalesce(F.col(weight) > most, F.lit(False))
    keys = (facts if weights is None else weights).where(hot).select(*on, F.lit(True).alias(is_hot))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    dealt = F.when(F.col(is_hot), F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).otherwise(0).cast("int")
    salted = rows.join(F.broadcast(keys), on, "left").withColumn(salt, dealt).drop(is_hot)
    repeated = facts.withColumn(salt, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*on, salt], "left").drop(salt)


def marked(rows: DataFrame, place: Column, places: DataFrame, own: Column, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether their ``place``, a long, is among those of ``places``.

    What is broadcast is one bit a place, in bitmaps of 32,768 places, so that ``rows`` are not shuffled.
    """
    bucket, bits = free([*rows.columns, flag], "bucket"), free([*rows.columns, flag], "bits")
    dealt = places.select(F.bitmap_bucket_number(own).alias(bucket), F.bitmap_bit_position(own).alias("bit")).repartition(bucket)
    maps = dealt.groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bits))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket, "left").withColumn(flag, found).drop(bucket, bits)


def sieved(rows: DataFrame, key: Column, keys: DataFrame, own: Column, total: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false where ``key`` is certainly none of ``keys``, so that only
    the others need be joined with them.

    Keys are marked at hashed places, SIEVE for each of ``total`` rows, half a byte in all; with few keys
    few others are flagged. Null is a key too.
    """
    places = F.lit(min(max(SIEVE * total, 1), MOST_PLACES)).cast("long")
    return marked(rows, F.pmod(F.xxhash64(key), places), keys, F.pmod(F.xxhash64(own), places), flag)


def parts(n: int, unit: int, least: int = 1) -> int:
    """How many parts of about ``unit`` make up ``n``."""
    return max(least, -(-int(n or 0) // unit))
