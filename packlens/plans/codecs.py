"""Queries on binary formats, hashes and codecs that SQL does not have; each is tested against a plain
implementation or a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary
from ..operators import cas
from ..operators.chunking import content_chunks
from ..session import ship
from ..sources import index
from ..sources.adapters import files
from .chunks import stored
from .register import query


@query()
def blake3_digests(spark, sf_dir):
    ship(spark)
    return files(spark, sf_dir).select("path", binary.blake3_hex(F.encode("content", "UTF-8")).alias("blake3"))


@query()
def zstd_objects(spark, sf_dir):
    """Distinct contents encoded, raw where that is not smaller, decoded again and compared."""
    ship(spark)
    objects = files(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), F.encode("content", "UTF-8").alias("raw")).dropDuplicates(["hash"])
    packed = objects.select("hash", "raw", binary.zstd_or_raw("raw").alias("e"))
    again = F.sha2(binary.decoded(F.col("e.codec"), F.col("e.payload")), 256)
    return packed.select("hash", F.col("e.codec").alias("codec"), F.octet_length("e.payload").alias("compressed_size"), F.octet_length("raw").alias("raw_size"), (again == F.col("hash")).alias("intact"))


@query()
def gear_chunks(spark, sf_dir):
    """Content-defined chunks of about 1 KiB."""
    return content_chunks(files(spark, sf_dir).select("path", F.encode("content", "UTF-8").alias("content")), 1024)


@query()
def gear_reuse(spark, sf_dir):
    """How much content-defined chunking finds again between two versions of every text."""
    f = files(spark, sf_dir).select("path", "content")
    old = content_chunks(f.select("path", F.encode("content", "UTF-8").alias("content")), 1024)
    new = content_chunks(f.select("path", F.encode(F.concat(F.lit("inserted "), "content"), "UTF-8").alias("content")), 1024)
    return cas.version_reuse(old, new)


@query("""SELECT hash, raw_size, compressed_size, substr(hash, 1, 1) AS shard FROM (
  SELECT DISTINCT sha256(substr(text, o + 1, 1024)) AS hash, least(1024, length(text) - o) AS raw_size, least(1024, length(text) - o) - least(1024, length(text) - o) // 3 AS compressed_size
  FROM (SELECT text, unnest(range(0, length(text), 1024)) AS o FROM documents))""")
def index_round_trip(spark, sf_dir):
    """Object records written as binary indexes, one for each first digit, and read again."""
    records = stored(spark, sf_dir).withColumn("shard", F.substring("hash", 1, 1)).withColumn("codec", F.lit("zstd"))
    small = records.where("compressed_size > 0")
    placed = cas.place(small, "shard", "compressed_size", ("hash",))
    blobs = index.write_index(placed, "shard")
    return index.read_index(blobs).select("hash", "raw_size", "compressed_size", F.substring("hash", 1, 1).alias("shard"))


@query("""SELECT sha256(text) AS hash, sha256(text) AS read_again, strlen(text) AS size, NULL::VARCHAR AS read_short FROM documents GROUP BY text""")
def promotion_cache(spark, sf_dir):
    """Entries of a promotion cache written and read as expressions; a wrong length is refused."""
    objects = files(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), F.encode("content", "UTF-8").alias("raw")).dropDuplicates(["hash"])
    size = F.octet_length("raw")
    entries = objects.withColumn("entry", index.promoted(F.col("hash"), F.col("raw")))
    back = index.read_promoted(F.col("entry"), F.col("hash"), size)
    short = index.read_promoted(F.col("entry"), F.col("hash"), size + 1)
    return entries.select("hash", F.sha2(back, 256).alias("read_again"), F.octet_length(back).cast("long").alias("size"), F.sha2(short, 256).alias("read_short"))


@query("""SELECT hash, raw_size, hash AS digest FROM (SELECT DISTINCT sha256(substr(text, o + 1, 1024)) AS hash, least(1024, length(text) - o) AS raw_size
FROM (SELECT text, unnest(range(0, length(text), 1024)) AS o FROM documents))""")
def pack_reads(spark, sf_dir):
    """Objects put into packs and read out of them by offset and length."""
    from ..operators.chunking import fixed_chunks

    data = fixed_chunks(files(spark, sf_dir).select("path", "content"), 1024, digest=False)
    objects = data.select(F.sha2("data", 256).alias("hash"), F.encode("data", "UTF-8").alias("data"), "raw_size").dropDuplicates(["hash"]).withColumn("compressed_size", F.octet_length("data").cast("long")).withColumn("shard", F.substring("hash", 1, 1))
    placed = cas.place(objects, "shard", "compressed_size", ("hash",), 65536)
    name = F.concat_ws("-", "shard", "pack_id")
    packs = placed.groupBy(name.alias("pack_id")).agg(F.array_sort(F.collect_list(F.struct("pack_offset", "data"))).alias("parts"))
    body = F.aggregate("parts", F.lit(b"\0" * 8), lambda acc, x: F.concat(acc, x["data"]))
    read = index.objects_of(packs.select("pack_id", body.alias("content")), placed.select("hash", name.alias("pack_id"), "pack_offset", "compressed_size", "raw_size", F.lit("raw").alias("codec")))
    return read.select("hash", "raw_size", F.sha2("payload", 256).alias("digest"))


@query("""SELECT doc_id, strlen(coalesce(text, '')) // 3 AS boundary FROM documents WHERE strlen(coalesce(text, '')) > 2 UNION ALL SELECT doc_id, strlen(text) FROM documents WHERE strlen(coalesce(text, '')) > 2""")
def chunks_at_boundaries(spark, sf_dir):
    """Content-defined chunks that begin anew behind the first third of every text: the ends that both have."""
    size = F.octet_length("content").cast("long")
    f = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.encode("content", "UTF-8").alias("content")).where(size > 2)
    f = f.withColumn("ends", F.array(F.floor(size / 3), size))
    found = content_chunks(f, 512, "ends").select("path", (F.col("offset") + F.col("raw_size")).alias("boundary"))
    return f.select("path", F.explode("ends").alias("boundary")).join(found, ["path", "boundary"], "left_semi").select(F.col("path").cast("long").alias("doc_id"), "boundary")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def log_events(spark, sf_dir):
    """Events as lines of a JSON log, of which those of one kind are picked."""
    from ..sources.documents import metric_event
    from ..sources.tables import scratch

    path = scratch(spark, "log")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct(F.col("event_type").alias("event"), "event_id", "user_id")).alias("value")).write.text(path)
    line = lambda name: F.get_json_object("value", f"$.{name}").cast("long").alias(name)
    return metric_event(spark, path, "click").select(line("event_id"), line("user_id"))


@query("""SELECT 'c' || doc_id // 50 AS "commit", 'game-' || doc_id AS identity, 'bin/d' || doc_id AS target, (['plain', 'save', 'missing', 'crash'])[doc_id % 4 + 1] AS launcher,
CASE WHEN doc_id % 4 > 1 THEN 'Broken' ELSE 'Tested' END AS status, doc_id // 50 % 3 <> 1 AS passed FROM documents""")
def receipt_records(spark, sf_dir):
    """Receipts of compatibility runs written as JSON, fifty programs each, read strictly and taken apart."""
    from ..sources import documents

    i = F.col("doc_id")
    none = F.array().cast("array<struct<level:string,receipt:string,commit:string>>")
    launcher = F.element_at(F.array(*map(F.lit, ("plain", "save", "missing", "crash"))), (i % 4 + 1).cast("int"))
    profile = {"game_identifier": F.concat(F.lit("game-"), i), "launch_target": F.concat(F.lit("bin/d"), i), "launcher_type": launcher, "status": F.when(i % 4 > 1, "Broken").otherwise("Tested"), "evidence": none, "limitations": F.array(F.lit("generated"))}
    record = F.struct(*(c.alias(k) for k, c in profile.items()))
    tested = F.struct(record.alias("record"), F.sha2("text", 256).alias("source_before_hash"), F.sha2("text", 256).alias("source_after_hash"), F.lit("PASS").alias("pass_fail"))
    run = F.floor(i / 50)
    receipts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(run.alias("run")).agg(F.collect_list(tested).alias("records"))
    whole = F.struct(F.lit(1).alias("schema"), F.lit("simulation").alias("evidence_level"), F.concat(F.lit("c"), "run").alias("commit_SHA"), "records", F.when(F.col("run") % 3 == 1, "FAIL").otherwise("PASS").alias("pass_fail"))
    return documents.receipt_rows(documents.strict(receipts.select(F.to_json(whole).alias("value")), documents.RECEIPT, version=None))
