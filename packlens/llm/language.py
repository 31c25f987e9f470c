"""Language identification by compression: the language whose dictionary makes the text smallest.

A language's dictionary is raw text: of the DICT_DOCS texts of the language that come first in the order
of a hash of their ids, a piece each of at most PIECE characters, from a place that the hash chooses.
That sample is the only thing that is bounded; every whole text is classified. Dictionaries are broadcast:
at most four bytes times PIECE times DICT_DOCS a language, and DICT_TOTAL for all of them, which more than
DICT_TOTAL / (4 * PIECE * DICT_DOCS) languages share by smaller samples.

What is compressed, in dictionaries and in texts, is the lower-cased text's letters with each distinct
word once, in the order of their first occurrence: capitals, marks, numbers and repeated lines would
else be matched within the text or not at all, and say nothing of its language. Texts are compressed
in blocks of BLOCK bytes, each with the whole dictionary, and the sizes summed: what a dictionary saves
of one block is bounded, so that in one piece a long text's margin would shrink with its length.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, prepare

DICT_DOCS, PIECE, DICT_TOTAL, LEVEL = 64, 2048, 1 << 27, 9
#: Bytes of distinct words that are compressed at a time.
BLOCK = 1 << 14
#: Bytes of distinct words up to which equal sizes are told apart by matches.
SHORT = 2048
#: A text is rejected when the runner-up's size is within this share of the smallest.
NARROW = 0.002
_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> bytes:
    return f" {' '.join(dict.fromkeys(_WORD.findall(text.lower())))} ".encode()


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: Column | None = None) -> dict[str, bytes]:
    """A dictionary for each language, from labelled rows with a text; a bounded sample of them.

    Rows without a label or text teach nothing; of repeated rows, each may be in the sample. An empty
    table gives no dictionary.
    """
    text = F.col(f"`{text_col}`")
    order = F.xxhash64(text) if order is None else order
    pieces = F.ceil(F.length(text) / PIECE)
    piece = F.substring(text, (F.pmod(F.xxhash64(order), F.greatest(pieces, F.lit(1))) * PIECE + 1).cast("int"), F.lit(PIECE))
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), piece.alias("text"), order.alias("o")).where("lang is not null and length(text) > 0")
    langs = rows.select("lang").distinct().count()
    most = max(1, min(DICT_DOCS, DICT_TOTAL // (4 * PIECE * max(1, langs))))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).where(F.col("at") <= most)
    found: dict[str, list[str]] = {}
    for row in rows.orderBy("lang", "at").collect():  # at most DICT_TOTAL bytes, or a piece a language
        found.setdefault(row["lang"], []).append(row["text"])
    return {lang: b"".join(map(distinct_words, texts)) for lang, texts in found.items()}


def _packers(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    found = []
    for name in sorted(dictionaries):
        raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        found.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False)))
    return found


def _size(packer: zstandard.ZstdCompressor, raw: bytes) -> int:
    """What all blocks of ``raw`` take."""
    return sum(len(packer.compress(raw[at : at + BLOCK])) for at in range(0, len(raw), BLOCK))


def _unlike(dictionary: bytes, raw: bytes) -> float:
    """The mean over the bytes of ``raw`` of 1 / (1 + length of the longest match in the dictionary that begins there)."""
    total, end = 0.0, 0
    for at in range(len(raw)):
        end = max(end, at)
        while end < len(raw) and raw[at : end + 1] in dictionary:
            end += 1
        total += 1 / (1 + end - at)
    return total / len(raw)


def _predict(held, narrow: float):
    """``held`` is the broadcast of the dictionaries."""
    packers: list[tuple[str, zstandard.ZstdCompressor]] = []

    def run(batches):
        dictionaries = held.value
        if not packers:
            packers.extend(_packers(dictionaries))
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text, letter in zip(*(batch.column(i).to_pylist() for i in (batch.num_columns - 2, batch.num_columns - 1))):
                if not letter or not packers:
                    best, score = "und", 0.0
                else:
                    raw = distinct_words(text)
                    sizes = sorted((_size(p, raw), name) for name, p in packers)
                    best = sizes[0][1]
                    score = 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]
                    if len(sizes) > 1 and sizes[0][0] == sizes[1][0] and len(raw) <= SHORT:
                        finer = sorted((_unlike(dictionaries[name], raw), name) for size, name in sizes if size == sizes[0][0])
                        best, score = finer[0][1], 1.0 - finer[0][0] / finer[1][0]
                langs.append(best)
                scores.append(score)
                rejected.append(best == "und" or len(packers) > 1 and score < narrow)
            own = list(range(batch.num_columns - 2))  # all but text and letter
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(batch.schema.names[i] for i in own), "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """Columns ``keep`` of every row with lang_pred, score and rejected; only the text is looked at.

    score is the share by which the smallest encoding undercuts the next (1 with one language);
    equal sizes of a short text are told apart by its matches in the dictionaries (_unlike, of which score
    is then the share), else they go to the first language by name. A null text, one without a letter, or any text when
    nothing was learned is ``und`` with score 0. Those and narrow margins are rejected. Very long texts are
    compressed whole, a block at a time. Repeated rows are judged alike; an empty table gives an empty
    result. Columns may have any names; of ``keep``, one named lang_pred, score or rejected is left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    text, own = F.col(f"`{text_col}`"), [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    hidden, letter = free(docs.columns, "text"), free(docs.columns, "letter")
    rows = docs.select(*(F.col(f"`{c}`") for c in own), text.alias(hidden), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letter))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(own)])
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(dictionaries), narrow), f"{kinds}lang_pred string, score double, rejected boolean")


def _known(held, narrow: float, text_at: int):
    judge = _predict(held, narrow)

    def run(batches):
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([batch.column(text_at), batch.column(batch.num_columns - 1)], names=["text", "letter"])
            rejected = next(judge([asked])).column("rejected")
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pc.invert(rejected))

    return run


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """The rows of ``docs`` that predict would not reject, with the columns they came with; see there."""
    spark = docs.sparkSession
    prepare(spark)
    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias(free(docs.columns, "letter"))
    return docs.select("*", letter).mapInArrow(_known(spark.sparkContext.broadcast(dictionaries), narrow, docs.columns.index(text_col)), docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    shown = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    dictionaries = learn(shown, order=F.xxhash64("doc_id"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return predict(rows, dictionaries, ["doc_id", "held_out"])
