"""Intermediate tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from ..session import is_local

_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir; a folder of our own only where that is unset."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(_own.setdefault("dir", tempfile.mkdtemp(prefix="packlens-")))
    return df.checkpoint()


def scratch(spark, label: str) -> str:
    """A new folder name in the shared folder, for what a query writes and reads again."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + _own.setdefault("dir", tempfile.mkdtemp(prefix="packlens-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
