"""The corpus pipeline: each stage does to its own input what its operator says."""

from __future__ import annotations

import random

from helpers import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as p
from packlens.llm import common, jaccard, language, mixing, packing, secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")  # stages are given tables
    known = p.known_language(spark, rows, SMALL)
    assert known.columns == rows.columns and known.count() < rows.count()
    one = p.one_of_each(spark, rows, SMALL)
    classes = {r["id"]: r["component"] for r in jaccard.near_duplicates(rows).collect()}
    kept = [classes[r["doc_id"]] for r in one.collect()]
    assert len(kept) == len(set(kept)) == len(set(classes.values()))
    assert {r["doc_id"] for r in one.collect()} == set(classes.values())  # a class is named by its smallest id
    clean = p.without_secrets(spark, rows, SMALL)
    spans, _ = secrets.scan(clean)
    assert clean.count() == rows.count() and spans.where("size(spans) > 0").isEmpty()
    assert clean.where("n_chars <> length(text)").isEmpty()
    copies = mixing.mixture(rows).selectExpr("sum(mix.copies)").first()[0]
    assert p.mixed(spark, rows, SMALL).count() == copies and p.mixed(spark, rows, SMALL).columns == rows.columns
    assert p.packed(spark, rows, SMALL).groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def test_the_same_documents_stay_however_files_are_split(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for least in ("4", "24"):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            out = p.one_of_each(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), SMALL)
            spark.conf.set("spark.sql.files.minPartitionNum", "9")  # and when it is read
            kept.append(sorted(r["doc_id"] for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    classes = {r["component"] for r in jaccard.near_duplicates(docs).collect()}
    assert kept[0] == kept[1] == sorted(classes)


def test_what_survives_of_odd_rows(spark):
    text = "alpha beta gamma delta omega alpha gamma beta omega delta secret=abcdefghij"
    rows = [(None, text, "xx", None, 1), (None, text, "yy", None, 1), (3, text, None, None, 1), (1, None, None, "s", 0), (1, "  ", "xx", "s", 9), (1, "", "xx", "s", 9), (2, "12 34", "yy", "s", 0), (2, "12 34", "yy", "s", 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    shape = lambda out: sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    taught = df.unionAll(spark.createDataFrame([(4, "alpha beta gamma delta omega", "xx", "s", 0), (8, "uno dos tres cuatro cinco", "yy", "s", 0)], COLUMNS))
    known = p.known_language(spark, taught, SMALL)
    assert {r["text"] for r in known.collect()} == {text, "alpha beta gamma delta omega", "uno dos tres cuatro cinco"}  # neither blank, null nor without letters
    assert shape(p.one_of_each(spark, df, SMALL)) == sorted([(3, text, 1), (1, None, 0), (1, "  ", 9), (1, "", 9), (2, "12 34", 0)], key=str)
    clean = text.replace("secret=abcdefghij", "[assign]")
    assert shape(p.without_secrets(spark, df, SMALL)) == sorted([(i, clean if t == text else t, len(clean) if t == text else None if t is None else len(t)) for i, t, *_ in rows], key=str)
    taken = {r["text"] for r in p.mixed(spark, df, SMALL).collect()}
    assert taken <= {t for _, t, *_ in rows} and text in taken


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    rng = random.Random(1)
    text = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega")) for _ in range(60))
    rows = [(None, text, "xx", None, 1), (None, text, None, None, 1), (1, None, None, "s", 0), (1, "secret=abcdefghij for all", "xx", "s", 9), (1, "secret=abcdefghij for all", "xx", "s", 9), (2, "", "yy", "s", 0)]
    for name, data in (("rows", rows), ("none", [])):
        spark.createDataFrame(data, COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    out = p.run(spark, f"{tmp_path}/rows")
    assert out.columns == packing.pack(spark.createDataFrame([], COLUMNS)).columns


def test_shape_and_run(spark):
    assert [name for name, _ in p.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "packing"]
    out = p.run(spark, SMALL)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty() and out.count() > 0
    assert language.NARROW < 0.01


def _shuffled(spark, work) -> int:
    """Bytes of shuffle that ``work`` writes."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        seen = context.statusStore().executorList(False)
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))

    before = total()
    work()
    return total() - before


def test_texts_that_stay_as_they_are_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    words = lambda: " ".join("".join(rng.choices("bcdghklmnpqrstvwxz", k=50)) for _ in range(400))
    rows = [(i, words() + (" secret=abcdefghij" if i % 50 == 0 else ""), "xx", "s", 1) for i in range(200)]
    rows.append((900, rows[7][1], "xx", "s", 1))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = sum(len(t) for _, t, *_ in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {}
        for stage in (p.one_of_each, p.without_secrets):
            assert _shuffled(spark, lambda: stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{stage.__name__}")) < size / 3, stage.__name__
            got[stage.__name__] = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/{stage.__name__}").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["one_of_each"] == {i: t for i, t, *_ in rows if i < 900}
    assert got["without_secrets"] == {i: t.replace("secret=abcdefghij", "[assign]") for i, t, *_ in rows}


def test_marks_are_exact_and_sieves_lose_no_key(spark):
    rows = spark.range(100_000).select(F.expr("if(id % 3 = 0, id * 7 + shiftleft(id % 5, 33), id)").alias("row"))
    keys = rows.where("row % 11 in (0, 1, 4)")
    assert common.marked(rows, F.col("row"), keys, F.col("row"), "flag").where("flag <> (row % 11 in (0, 1, 4))").isEmpty()
    text = F.when(F.col("row") > 0, F.col("row").cast("string"))
    few = rows.where("row % 50 = 0")
    got = common.sieved(rows, text, few, text, 100_000, "flag")
    assert got.count() == 100_000 and got.where("row % 50 = 0 and not flag").isEmpty() and got.where("row % 50 <> 0 and flag").count() < 2_000
