"""JSON records and logs: strict reading, writing that never overwrites, and trees of files.

Spark's JSON reader drops keys that it does not know; these readers refuse them, and records of another
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import valid_key, valid_path

MOST_LINE = 256 << 10

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "u64": T.DecimalType(20, 0), "str": T.StringType(), "bool": T.BooleanType()}


def _kind(x) -> T.DataType:
    return _KINDS[x] if isinstance(x, str) else x


def _record(**fields) -> T.StructType:
    """A struct type from field names and kinds; made without a session."""
    return T.StructType([T.StructField(name, _kind(x)) for name, x in fields.items()])


def _many(x) -> T.ArrayType:
    return T.ArrayType(_kind(x))


def _by_name(x) -> T.MapType:
    return T.MapType(T.StringType(), _kind(x))


TRACE = _record(version="int", session="str", ts_ns="long", op="str", path="str", offset="long", requested="long", returned="u64", latency_ns="long", cache="str", source="str", worker="str", success="bool")
_CHUNK = _record(hash="str", offset="long", raw_size="long")
_FILE = _record(path="str", size="long", mode="int", hash="str", chunks=_many(_CHUNK))
MANIFEST = _record(format="str", version="int", layout="str", chunker="str", chunk_size="long", zstd_level="int", directories=_many("str"), files=_many(_FILE))
_PREFETCH = _record(enabled="bool", sequential_reads="int", max_chunks="int", budget_bytes="long", queue_depth="int", ttl_ms="long")
POLICY = _record(version="int", cache_bytes="long", eviction="str", decay_accesses="long", prefetch=_PREFETCH, files=_by_name("int"))
TIERS = _record(version="int", primary_cache="str", secondary="str", remote=_record(base_url="str", timeout_ms="long", retries="int"), promote="bool")
_ENGINE = _record(key="str", confidence="int", version="str", evidence=_many("str"))
SCANNER = _record(
    path="str", name="str", store="str", appid="str", engine=_ENGINE, other_engine_signals=_many(_record(key="str", evidence=_many("str"))),
    anti_cheat=_many("str"), executables=_by_name(_record(managed="bool", arch="str")), index_truncated="bool")
_EVIDENCE = _record(level="str", receipt="str", commit="str")
_PROFILE = _record(game_identifier="str", launch_target="str", launcher_type="str", status="str", os="str", architecture="str", tested_version="str", test_date="str", evidence=_many(_EVIDENCE), limitations=_many("str"))
_TESTED = _record(record=_PROFILE, source_before_hash="str", source_after_hash="str", pass_fail="str")
RECEIPT = _record(schema="int", evidence_level="str", commit_SHA="str", records=_many(_TESTED), fixture_sha256="str", commercial_game_compatibility="str", pass_fail="str", error="str")
# How a tested program is run, and what may be said of it.
LAUNCHERS = ("plain", "launcher", "multiple", "case", "save", "missing", "crash")
STATUSES = ("Tested", "Broken", "Unsupported")
# Engine keys and their labels.
ENGINES = {
    "unity-mono": "Unity (Mono)", "unity-il2cpp": "Unity (IL2CPP)", "unreal": "Unreal Engine", "godot": "Godot", "gamemaker": "GameMaker", "source": "Source 1", "source2": "Source 2",
    "creation": "Bethesda Creation", "rage": "Rockstar RAGE", "redengine": "REDengine", "fromsoft": "FromSoftware", "idtech": "id Tech", "native": "Unknown native engine",
}


def strict(lines: DataFrame, schema: T.StructType, version: int | None = 1, text: str = "value", most: int = MOST_LINE) -> DataFrame:
    """Records parsed from JSON texts; any malformed text, unknown top-level key, over-long text or other
    version is an error."""
    raw = F.col(text)
    keys = F.json_object_keys(raw)
    known = F.array(*(F.lit(f.name) for f in schema))
    refused = F.when(F.octet_length(raw) > most, "line too long").when(keys.isNull(), "no JSON object").when(F.size(F.array_except(keys, known)) > 0, "unknown key")
    if version is not None:
        refused = refused.when(~F.get_json_object(raw, "$.version").cast("int").eqNullSafe(F.lit(version)), "unsupported version")
    checked = F.when(refused.isNotNull(), F.raise_error(F.concat(refused, F.lit(": "), F.substring(raw, 1, 80)))).otherwise(raw)
    own = [c for c in lines.columns if c != text]
    return lines.select(*own, F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("__r")).select(*own, "__r.*")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files with seq, their place: file by file, line by line."""
    from ..operators.numbering import numbered

    at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", *at)
    events = strict(numbered(lines, ["file", "block", "line"], "seq", 0).select("seq", "value"), TRACE)
    unsafe = (F.col("path") != "") & ~valid_path(F.col("path"))
    return events.withColumn("path", F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe path: "), "path"))).otherwise(F.col("path")))


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines in a folder that must not exist."""
    df.write.mode("errorifexists").json(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, version: int | None = 1, most: int = 16 << 20) -> DataFrame:
    """JSON records, one a line or a file, strictly."""
    return strict(spark.read.text(path), schema, version, most=most)


def manifest_tables(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """directories (path), files (path, size, mode, hash) and chunks (path, ordinal, hash, offset, raw_size)."""
    f = manifest.select(F.explode("files").alias("f"))
    chunks = f.select(F.col("f.path").alias("path"), F.posexplode("f.chunks").alias("ordinal", "c"))
    return manifest.select(F.explode("directories").alias("path")), f.select("f.path", "f.size", "f.mode", "f.hash"), chunks.select("path", F.col("ordinal").cast("long").alias("ordinal"), "c.*")


def manifest_of(files: DataFrame, chunks: DataFrame, shard: str, layout: str = "packs", chunker: str = "fixed", chunk_size: int = 262144) -> DataFrame:
    """Manifests from tables of files and chunks, one for each shard of the files (a column): the reverse
    of manifest_tables. A shard is what one row can hold."""
    one = F.struct("ordinal", "hash", "offset", "raw_size")
    parts = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: F.struct(c["hash"].alias("hash"), c["offset"].alias("offset"), c["raw_size"].alias("raw_size"))).alias("chunks"))
    none = F.array().cast("array<struct<hash:string,offset:bigint,raw_size:bigint>>")
    whole = files.join(parts, "path", "left").select(F.col(shard).alias("__shard"), F.struct("path", "size", "mode", "hash", F.coalesce("chunks", none).alias("chunks")).alias("f"))
    head = {"format": F.lit("store"), "version": F.lit(1), "layout": F.lit(layout), "chunker": F.lit(chunker), "chunk_size": F.lit(chunk_size).cast("long"), "zstd_level": F.lit(3)}
    return whole.groupBy("__shard").agg(F.array_sort(F.collect_list("f")).alias("files")).select(*(c.alias(k) for k, c in head.items()), F.array().cast("array<string>").alias("directories"), "files")


def metric_event(spark: SparkSession, path: str, event: str = "unmounted") -> DataFrame:
    """The lines of a log that report an event."""
    return spark.read.text(path).where(F.get_json_object("value", "$.event") == event)


def scan_tree(spark: SparkSession, root: str, content: bool = False, most_depth: int | None = None, most_files: int | None = None, ordered: bool = True) -> DataFrame:
    """path (below root), size, depth and, if asked for, content of all files below a folder, in order of
    their paths unless ``ordered`` is false, which spares content a shuffle. Unsafe names are an error, and
    so are more files than allowed."""
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.split(":", 1)[-1] if ":" in root else root
    rel = F.substring(base, len("/" + top.strip("/") + "/") + 1, 1 << 20)
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), *(["content"] if content else []))
    rows = rows.withColumn("depth", F.size(F.split("path", "/")) - 1)
    rows = rows.withColumn("path", F.when(~valid_path(F.col("path")), F.raise_error(F.concat(F.lit("unsafe name: "), "path"))).otherwise(F.col("path")))
    if most_depth is not None:
        rows = rows.where(F.col("depth") <= most_depth)
    if most_files is not None and rows.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"more than {most_files} files below {root}")
    return rows.orderBy("path") if ordered else rows


def sealed(payload, digest):
    """A JSON payload whose SHA-256 is the stated one; anything else is an error."""
    return F.when(F.sha2(payload, 256) == digest, payload).otherwise(F.raise_error(F.lit("digest of the snapshot differs")))


def normalize_scan(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Scanner reports (SCANNER rows) with a label for their engine and evidence that exists: of the
    named paths, those that are files, by their own names, sorted, each once."""
    label = F.create_map(*(F.lit(x) for pair in ENGINES.items() for x in pair))
    named = reports.select("path", F.explode_outer("engine.evidence").alias("evidence"))
    real = files.select(F.col("path").alias("file"), F.lower("path").alias("low"))
    kept = named.join(real, F.lower("evidence") == F.col("low"), "left").groupBy("path").agg(F.array_sort(F.collect_set("file")).alias("evidence_paths"))
    key = F.col("engine.key")
    bad = key.isNull() | ~key.rlike(r"^[a-z0-9][a-z0-9-]*\z") | ~F.col("engine.confidence").between(0, 100)
    engine = F.when(bad, F.raise_error(F.lit("invalid engine"))).otherwise(key)
    return reports.join(kept, "path", "left").select(
        "path", engine.alias("engine"), F.coalesce(F.element_at(label, key), key).alias("label"), F.col("engine.confidence").alias("confidence"), "evidence_paths",
        F.array_sort(F.array_distinct(F.coalesce("anti_cheat", F.array().cast("array<string>")))).alias("anti_cheat"), F.coalesce("index_truncated", F.lit(False)).alias("truncated"))


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Gives a folder another name, which must be free."""
    fs, at = _at(spark, old)
    if exists(spark, new):
        raise FileExistsError(new)
    if not fs.rename(at, _at(spark, new)[1]):
        raise OSError(f"cannot publish {new}")


def receipt_rows(receipts: DataFrame) -> DataFrame:
    """commit, identity, target, launcher, status, passed: a row for each program that a receipt (RECEIPT rows)
    says was tested. An unsafe identity or target, a launcher or status there is none of, more than 128
    programs, or a source that the test has changed is an error."""
    r = receipts.select(F.col("commit_SHA").alias("commit"), "records", (F.col("pass_fail") == "PASS").alias("all_passed"))
    bounded = F.when(F.size("records") <= 128, F.col("records")).otherwise(F.raise_error(F.lit("too many records")))
    t = r.select("commit", "all_passed", F.explode(bounded).alias("t")).select("commit", "all_passed", "t.*").select("*", "record.*")
    good = valid_key(F.col("game_identifier")) & valid_path(F.col("launch_target")) & ~F.contains("launch_target", F.lit(":"))
    known = F.col("launcher_type").isin(*LAUNCHERS) & F.col("status").isin(*STATUSES)
    wrong = F.when(~F.coalesce(good, F.lit(False)), "unsafe profile").when(~F.coalesce(known, F.lit(False)), "unknown launcher or status").when(~F.col("source_before_hash").eqNullSafe(F.col("source_after_hash")), "source changed")
    identity = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.coalesce("game_identifier", F.lit("null"))))).otherwise(F.col("game_identifier"))
    return t.select("commit", identity.alias("identity"), F.col("launch_target").alias("target"), F.col("launcher_type").alias("launcher"), "status", ((F.col("pass_fail") == "PASS") & F.col("all_passed")).alias("passed"))


def swap_in(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table by df: written beside it, the old one kept as .backup, then renamed."""
    import uuid

    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}.new"
    df.write.mode("errorifexists").parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, staged, backup = hadoop.Path(path), hadoop.Path(new), hadoop.Path(f"{path}.backup")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.delete(backup, True)
        if not fs.rename(at, backup):
            raise OSError(f"cannot keep {path}")
    if not fs.rename(staged, at):
        raise OSError(f"cannot publish {path}")
