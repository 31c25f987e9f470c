"""Queries that write the driver's tables in the formats of a store and read them again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binary import appledouble
from ..operators import validity
from ..session import ship
from ..sources import documents, windows, zipfiles
from ..sources.adapters import CHUNK, CHUNKS, FILES, TRACE, files, trace
from ..sources.tables import scratch
from .chunks import chunks
from .register import query

#: Bytes of a file that tree_scan writes, about.
TREE_FILE = 4 << 20


@query(f"""WITH {TRACE} SELECT seq, version, session, ts_ns, op, path, "offset", requested, returned::DECIMAL(20, 0) AS returned, latency_ns, cache, source, worker, success FROM trace""")
def trace_json_round_trip(spark, sf_dir):
    """A trace written as JSON lines in order of arrival and read strictly; seq comes from the place."""
    path = scratch(spark, "trace")
    documents.write_new(trace(spark, sf_dir).orderBy("seq").drop("seq"), path)
    return documents.read_trace(spark, path)


@query(f'WITH {CHUNKS} SELECT path, ordinal, hash, "offset", raw_size FROM chunks')
def manifest_round_trip(spark, sf_dir):
    """Manifests, one a top directory, written as JSON and read strictly."""
    f = files(spark, sf_dir).select("path", F.length("content").cast("long").alias("size"), "mode", F.sha2("content", 256).alias("hash"), F.substring_index("path", "/", 1).alias("top"))
    path = scratch(spark, "manifests")
    documents.write_new(documents.manifest_of(f, chunks(spark, sf_dir), "top", chunk_size=CHUNK), path)
    return documents.manifest_tables(documents.read_documents(spark, path, documents.MANIFEST, most=1 << 30))[2]


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    """An archive for each list of texts: members in order, stored and deflated in turn."""

    def pack(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, text in enumerate(members):
                info = zipfile.ZipInfo(f"dir/m{i}", (2020, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
                z.writestr(info, text)
        return out.getvalue()

    return texts.map(pack)


@query("SELECT 'c' || conv_id AS path, count(*) + 1 AS boundaries, true AS at_end, true AS ascending, false AS broken_accepted FROM conversations GROUP BY conv_id")
def zip_boundaries(spark, sf_dir):
    """Record ends of archives made of conversations; a damaged archive has none."""
    ship(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.concat(F.lit("c"), "conv_id").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    archives = turns.select("path", _zipped("texts").alias("content"))
    found = zipfiles.boundaries(archives).select("path", "boundaries")
    broken = zipfiles.boundaries(archives.select("path", F.concat("content", F.lit(b"!")).alias("content"))).select("path", F.col("boundaries").isNotNull().alias("broken_accepted"))
    both = found.join(archives.select("path", F.octet_length("content").alias("size")), "path").join(broken, "path")
    last = F.element_at("boundaries", -1) == F.col("size")
    return both.select("path", F.size("boundaries").cast("long").alias("boundaries"), last.alias("at_end"), (F.array_sort("boundaries") == F.col("boundaries")).alias("ascending"), "broken_accepted")


@query("""SELECT 'p' || page_id AS path, s.i AS place, ':' || CASE WHEN s.i = 0 THEN '' ELSE 'note' END || ':$DATA' AS stream, page_id * 3 + s.i AS logical_bytes, page_id * 4096 AS allocated_bytes FROM pages, range(2) s(i)""")
def stream_buffers(spark, sf_dir):
    """Stream lists of files, built as bytes and parsed."""
    i = F.col("page_id")
    number = lambda n, width: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(width))))
    entry = lambda step, name, logical: F.concat(number(F.lit(step).cast("long"), 4), number(F.lit(len(name) * 2).cast("long"), 4), number(logical, 8), number(i * 4096, 8), F.lit(name.encode("utf-16-le")))
    first = entry(40, "::$DATA", i * 3)
    buffer = F.concat(first, F.lit(b"\0\0"), entry(0, ":note:$DATA", i * 3 + 1))
    rows = windows.streams(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), i).alias("path"), buffer.alias("content")))
    return rows.select("path", F.when(F.col("stream") == "::$DATA", 0).otherwise(1).cast("long").alias("place"), "stream", "logical_bytes", "allocated_bytes")


@query("SELECT page_id, page_id % 4 = 0 AS sidecar FROM pages")
def appledouble_sidecars(spark, sf_dir):
    """Bytes that are metadata sidecars: of each four, one is, and one each fails by magic, size and entry."""
    head = bytes.fromhex("0005160700020000") + b"Mac OS X        " + bytes.fromhex("0002")
    entries = lambda kind, offset, size: kind.to_bytes(4, "big") + offset.to_bytes(4, "big") + size.to_bytes(4, "big")
    good = head + entries(9, 50, 32) + entries(2, 82, 5) + b"f" * 32 + b"r" * 5
    forms = (good, b"\1" + good[1:], good[:-1], head + entries(8, 50, 32) + entries(2, 82, 5) + b"f" * 37)
    data = F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", appledouble(data).alias("sidecar"))


@query(f"""WITH {FILES} SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'decay_accesses' WHEN doc_id % 4 = 2 THEN 'ttl_ms' ELSE 'files' END AS reasons FROM files WHERE doc_id % 4 > 0""")
def policy_violations(spark, sf_dir):
    """Policies as JSON records, read strictly; of each four, three have a value out of range."""
    i = F.col("doc_id")
    ahead = F.struct(F.lit(True).alias("enabled"), F.lit(3).alias("sequential_reads"), F.lit(2).alias("max_chunks"), F.lit(1024).alias("budget_bytes"), F.lit(32).alias("queue_depth"), F.when(i % 4 == 2, 0).otherwise(500).alias("ttl_ms"))
    record = F.struct(F.lit(1).alias("version"), F.lit("lru").alias("eviction"), F.when(i % 4 == 1, 0).otherwise(64).alias("decay_accesses"), ahead.alias("prefetch"), F.create_map(F.when(i % 4 == 3, "../up").otherwise(F.col("path")), F.lit(5)).alias("files"))
    lines = files(spark, sf_dir).select(i.alias("id"), F.to_json(record).alias("value"))
    return validity.policy_violations(documents.strict(lines, documents.POLICY)).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 'promotion without a cache' ELSE 'remote limits' END AS reason FROM documents WHERE doc_id % 3 > 0")
def tier_violations(spark, sf_dir):
    i = F.col("doc_id")
    remote = F.struct(F.lit("http://localhost").alias("base_url"), F.lit(1000).alias("timeout_ms"), F.when(i % 3 == 2, 9).otherwise(2).alias("retries"))
    record = F.struct(F.lit(1).alias("version"), F.when(i % 3 != 1, "/cache").alias("primary_cache"), remote.alias("remote"), F.lit(True).alias("promote"))
    lines = files(spark, sf_dir).select(i.alias("id"), F.to_json(record).alias("value"))
    return validity.tier_violations(documents.strict(lines, documents.TIERS))


@query("""SELECT 'r' || doc_id AS path, 'godot' AS engine, 'Godot' AS label, 90 AS confidence, source || '/' || lang || '/d' || doc_id AS evidence_paths, 'x,y' AS anti_cheat, false AS truncated FROM documents""")
def scanner_reports(spark, sf_dir):
    """Scanner reports as JSON: evidence is matched to real files whatever its case, and prose is left out."""
    f = files(spark, sf_dir)
    engine = F.struct(F.lit("godot").alias("key"), F.lit(90).alias("confidence"), F.array(F.upper("path"), F.col("path"), F.lit("looks like it")).alias("evidence"))
    record = F.struct(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("path"), engine.alias("engine"), F.array(F.lit("y"), F.lit("x"), F.lit("y")).alias("anti_cheat"))
    reports = documents.strict(f.select(F.to_json(record).alias("value")), documents.SCANNER, version=None)
    out = documents.normalize_scan(reports, f.select("path"))
    return out.select("path", "engine", "label", "confidence", F.array_join("evidence_paths", ",").alias("evidence_paths"), F.array_join("anti_cheat", ",").alias("anti_cheat"), "truncated")


@query("SELECT doc_id, doc_id + 1 AS next_id FROM documents")
def snapshot_envelopes(spark, sf_dir):
    """Overlay snapshots with their digests: a payload is parsed only if its digest is right."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.to_json(F.struct((F.col("doc_id") + 1).alias("next_id"))).alias("payload"))
    sealed = d.withColumn("digest", F.sha2("payload", 256))
    return sealed.select("doc_id", F.get_json_object(documents.sealed(F.col("payload"), F.col("digest")), "$.next_id").cast("long").alias("next_id"))


@query("SELECT 'f' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, 1 AS depth, sha256(text) AS hash FROM documents WHERE false UNION ALL SELECT source || '/' || lang, NULL, 1, NULL FROM documents WHERE false")
def empty_scan(spark, sf_dir):
    """A tree without files gives no rows."""
    path = scratch(spark, "tree")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return documents.scan_tree(spark, path, content=True).select("path", "size", "depth", F.sha2("content", 256).alias("hash"))


@query(f"""WITH {FILES} SELECT split_part(path, '/', 1) AS directory, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1""")
def tree_scan(spark, sf_dir):
    """The texts of each source written as a tree of files and scanned again.

    A scanned file is one row, so a source's texts, one a line, are dealt out to files of about TREE_FILE
    bytes (one with a longer text is longer). Names are written in hex and every line begins with a mark,
    so that no name is escaped and no empty text is lost at a file's end.
    """
    path = scratch(spark, "tree")
    f = files(spark, sf_dir).select(F.concat(F.lit("x"), F.hex(F.substring_index("path", "/", 1))).alias("directory"), "content", F.monotonically_increasing_id().alias("row"))
    # those of more than one file are as many as there are files at most, however many sources there are
    split = f.groupBy("directory").agg(F.ceil(F.sum(F.octet_length("content").cast("long")) * 4 / 3 / TREE_FILE).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = f.join(F.broadcast(split), "directory", "left").select("directory", part, "content").repartition("directory", "part")
    text = F.concat(F.lit("t"), F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"\s", ""))
    dealt.select("directory", "part", F.coalesce(text, F.lit("n")).alias("line")).write.partitionBy("directory", "part").text(path)
    found = documents.scan_tree(spark, path, content=True, ordered=False).where(F.col("path").startswith("directory="))
    name = F.decode(F.unhex(F.regexp_extract("path", "^directory=x([^/]*)/", 1)), "UTF-8")
    lines = found.select(name.alias("directory"), F.explode(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
    size = F.when(F.col("line").startswith("t"), F.octet_length(F.unbase64(F.substr("line", F.lit(2)))).cast("long"))
    return lines.groupBy("directory").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
