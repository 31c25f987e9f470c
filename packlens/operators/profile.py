"""Content profiles: classes of files by name and first bytes, probes, and the packing plans they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import entropy_millibits, probe_offsets
from ..functions.paths import extension
from ..session import ship

SAMPLE, INCOMPRESSIBLE = 64 << 10, 7900

# First bytes, name endings and the classes they stand for.
SIGNATURES = (
    ("504B0304", "zip-local-header"), ("556E6974794653", "unityfs"), ("47445043", "godot-pck"), ("56504B00", "source-vpk"), ("3412AA55", "source-vpk"),
    ("42534100", "bethesda-bsa"), ("42544458", "bethesda-ba2"), ("52504637", "rage-rpf"), ("4D5A", "executable-header"), ("7F454C46", "executable-header"), ("CFFAEDFE", "executable-header"),
)
HINTS = {
    "zip-family": ("zip", "pk3", "pk4", "jar", "love"), "ambiguous-pak": ("pak",), "unreal-iostore-candidate": ("utoc", "ucas"), "godot-pck-candidate": ("pck",),
    "source-vpk-candidate": ("vpk",), "bethesda-archive-candidate": ("bsa", "ba2"), "rage-rpf-candidate": ("rpf",), "redengine-archive-candidate": ("archive",),
    "fromsoft-container-candidate": ("dcx", "bnd", "bdt"), "unity-assets-candidate": ("bundle", "assets"),
}
CLASSES = {
    "code": ("exe", "dll", "so", "dylib"), "scripts-text": ("js", "lua", "py", "txt", "gd", "cs"), "metadata": ("json", "ini", "xml", "cfg", "yaml"), "texture": ("dds", "png", "jpg", "ktx"),
    "audio": ("ogg", "mp3", "wav", "flac"), "video": ("mp4", "webm", "bik", "bk2"), "shader-cache": ("spv", "shader", "cache"), "binary": ("bin", "dat"),
}
REASON_RAW = "sampled blocks did not shrink; the rest of the file may"
REASON_ZSTD = "compress, and keep what does not shrink as it is"


def _by_name(table: dict[str, tuple[str, ...]], ending: Column, default: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, endings in table.items():
        out = out.when(ending.isin(*endings), name)
    return out.otherwise(F.lit(default).cast("string"))


def classify(files: DataFrame, path: str = "path", head: str = "head") -> DataFrame:
    """The rows with class, hint and signature. What the first bytes say of programs comes first, then
    any sign of a container, then the name."""
    ending, digits = extension(F.col(path)), F.hex(F.col(head))
    signature = F.when(F.lit(False), F.lit(None).cast("string"))
    for magic, name in SIGNATURES:
        signature = signature.when(F.startswith(digits, F.lit(magic)), name)
    rows = files.withColumn("signature", signature).withColumn("hint", _by_name(HINTS, ending, None))
    container = F.col("hint").isNotNull() | F.col("signature").isNotNull()
    kind = F.when(F.col("signature") == "executable-header", "code").when(container, "container").otherwise(_by_name(CLASSES, ending, "unknown"))
    return rows.withColumn("class", kind)


def probes(files: DataFrame, sample: int = SAMPLE, content: str = "content") -> DataFrame:
    """path, size, offset, bytes, digest and entropy of each file's probes (start, middle and end)."""
    ship(files.sparkSession)
    size = F.octet_length(content).cast("long")
    at = files.select("path", size.alias("size"), F.explode(probe_offsets(size, sample)).alias("offset"), F.col(content).alias("content"))
    part = F.substring("content", (F.col("offset") + 1).cast("int"), F.lit(sample))
    cut = at.select("path", "size", "offset", part.alias("part"))
    return cut.select("path", "size", "offset", F.octet_length("part").cast("long").alias("bytes"), F.sha2("part", 256).alias("digest"), entropy_millibits(F.col("part")).alias("entropy"))


def candidates(probed: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """path, sampled_bytes, repeated, candidate: large enough for three probes, none of them repeated,
    none that shrank, all near the entropy of noise. probed may have zstd_bytes; else no probe shrank."""
    shrank = F.col("zstd_bytes") < F.col("bytes") if "zstd_bytes" in probed.columns else F.lit(False)
    by_file = probed.groupBy("path", "size").agg(
        F.sum("bytes").alias("sampled_bytes"), F.count("*").alias("probes"), (F.count("*") - F.count_distinct("digest")).alias("repeated"),
        F.bool_and((F.col("entropy") >= INCOMPRESSIBLE) & ~shrank).alias("dense"))
    flag = (F.col("size") >= 3 * sample) & (F.col("probes") == 3) & (F.col("repeated") == 0) & F.col("dense")
    return by_file.select("path", "size", "sampled_bytes", "repeated", flag.alias("candidate"))


def plans(profiles: DataFrame, container_aware: bool, skip_compression: bool) -> DataFrame:
    """The rows with chunk_strategy, compression_strategy and reason. profiles: candidate, boundaries."""
    at_records = F.lit(container_aware) & F.col("boundaries").isNotNull()
    raw = F.lit(skip_compression) & F.col("candidate")
    out = profiles.withColumn("chunk_strategy", F.when(at_records, "zip-records-cdc").otherwise("cdc")).withColumn("compression_strategy", F.when(raw, "measured-raw").otherwise("try-zstd"))
    return out.withColumn("boundaries", F.when(at_records, F.col("boundaries")).otherwise(F.array().cast("array<bigint>"))).withColumn("reason", F.when(raw, REASON_RAW).otherwise(REASON_ZSTD))


def stale(stored: DataFrame, profiles: DataFrame, key: str, container_aware: bool, skip_compression: bool) -> DataFrame:
    """``key`` and reason of stored plans that are not what plans would say of the source today: changed,
    or without a source, or a source without a plan. Whole plans are compared, nulls being equal."""
    fields = ("chunk_strategy", "compression_strategy", "reason", "boundaries")
    whole = lambda rows, name: rows.select(key, F.struct(*fields).alias(name))
    now = whole(plans(profiles, container_aware, skip_compression), "now")
    both = whole(stored, "then").join(now, key, "full")
    reason = F.when(F.col("now").isNull(), "no source").when(F.col("then").isNull(), "no plan").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def extents(content: Column, block: int = 4096) -> Column:
    """Where a file's bytes are data: start and end of the runs of blocks that are not all zero."""
    size = F.octet_length(content).cast("long")
    part = lambda i: F.substring(content, (i * block + 1).cast("int"), F.lit(block))
    last = F.floor((size - 1) / block)
    zeros = F.lit(bytes(block))
    held = F.filter(F.sequence(F.lit(0).cast("long"), last), lambda i: part(i) != F.substring(zeros, F.lit(1), F.octet_length(part(i))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def grow(acc, i):
        one = F.struct((i * block).alias("start"), F.least((i + 1) * block, size).alias("end"))
        open_ = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(open_["start"].alias("start"), one["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == i * block), joined).otherwise(F.concat(acc, F.array(one)))

    return F.when(size > 0, F.aggregate(held, none, grow)).otherwise(none)


def extents_digest(content: Column, found: Column) -> Column:
    """SHA-256 over the extents, each as start and end (eight bytes, little-endian) and its bytes."""
    little = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8))))
    piece = lambda x: F.concat(little(x["start"]), little(x["end"]), F.substring(content, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return F.sha2(F.aggregate(found, F.lit(b""), lambda acc, x: F.concat(acc, piece(x))), 256)


def ascending(values: Column) -> Column:
    """Whether each element of an array is behind the one before it."""
    inner = F.sequence(F.lit(1), F.size(values) - 1)
    return F.when(F.size(values) < 2, F.lit(True)).otherwise(F.forall(inner, lambda i: F.element_at(values, i) < F.element_at(values, i + 1)))
