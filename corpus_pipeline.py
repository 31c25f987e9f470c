"""A corpus from documents to training sequences, in five stages.

run(spark, sf_dir) applies STAGES to the documents of sf_dir in turn; what a stage returns is written
as Parquet to the shared folder and read again, so that no stage depends on the lineage of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.common import Saved, free, marked
from packlens.llm.jaccard import near_duplicates
from packlens.llm.language import held_out, keep_known, learn
from packlens.llm.mixing import emit, mixture
from packlens.llm.packing import pack
from packlens.llm.secrets import redact


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or with a narrow margin go.

    Null, empty and blank texts have no letter and go; very long ones are judged whole; repeated rows are
    judged alike; rows without an id or label teach nothing, but are judged. Where nothing could be
    learned, no language is known and nothing stays. An empty table gives an empty result.
    """
    shown = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return keep_known(docs, learn(shown, order=F.xxhash64("doc_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id.

    Rows are numbered once, in a table that is written; everything else reads it, so that no number
    depends on how a reading is split. Null or repeated ids lose no document: a null id comes after all
    others, and the number decides between equal ones. Documents without words (null, empty or blank
    texts) are alone and stay; very long texts are compared whole; repeated rows are one class; an empty
    table gives an empty result. Columns may have any names. The rows that stay are told by one bit a
    row, so that texts are not shuffled.
    """
    row = free(docs.columns, "row")
    placed = Saved(docs.withColumn(row, F.monotonically_increasing_id()), "placed")
    classes = near_duplicates(placed.df, id_col=row).select(F.col("id").alias(row), "component")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    named = classes.join(placed.df.select(row, "doc_id"), row)
    first = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    stays = free(placed.df.columns, "stays")
    return marked(placed.df, F.col(row), first, F.col(row), stays).where(F.col(stays)).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by their kind and its length counted anew.

    Null and empty texts stay as they are; very long ones are changed whole; repeated rows stay repeated;
    an empty table gives an empty result.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null, empty and blank texts have no words and are taken by
    their source's rate too; rows that repeat an id are taken alike; an empty table gives an empty result.
    """
    return emit(mixture(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is one piece, its end id; a very long one is many; repeated rows are packed as
    often as they occur; an empty table gives an empty result.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the compression nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Saved(stage(spark, docs, sf_dir), name).df
    return docs
