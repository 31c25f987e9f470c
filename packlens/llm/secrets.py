"""Secret scans with an incremental ledger of blobs.

Every version of every text is content-addressed by SHA-256. The ledger, a Parquet table in the shared
folder, says which blobs a version of the rules has scanned and what was found in them. A scan takes
the blobs of its input that the ledger lacks for its rules, reads one text of each, and appends the
findings; findings are then joined back to every path that holds the blob. A group of copies is thus
scanned once, whatever its size, and hashes, not texts, are what is grouped. A text that is certainly
the only one of its blob, and new, is scanned where it is read; only others are joined to choose one.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, free, join_unique, prepare, sieved, work_dir

#: kind, pattern, least length, the group whose length counts. The first three are the fixed base.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: What stands between the lines of a key, be they quoted or joined by written-out line ends.
_BREAK = r"""(?:\\[nr]|[\s"'>,#*])++"""
#: From BEGIN to the END of the same label with no other mark between; else to the end of the headers and base64 behind BEGIN, if any.
_PEM = (
    r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Za-z][A-Za-z-]*+:\x20?[^\s\\]++)*+(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+)++(?:={{1,2}}|{_BREAK}[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=[\x20\t]*(?:[\r\n\\\x22']|$))))?)?"
)
MORE = (
    ("pem", _PEM, 1, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 1, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
)
RULES = BASE + MORE
#: What a text must hold, in lower-cased bytes, for a kind to be looked for at all.
_HINTS = {"assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), "access": (b"akia",), "pem": (b"-----begin",), "github": (b"gh",), "jwt": (b"eyj",), "slack": (b"xox",)}
#: A run shorter than the least length is no match and cannot hide one: such rules may ask for the length at once.
_DIRECT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = f"blob string, spans {_SPANS}"


def rules_version(rules: tuple = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    for place, (kind, pattern, least, group) in enumerate(rules):
        hints = _HINTS.get(kind, ())
        if hints and not any(h in low for h in hints):
            continue
        for m in re.finditer(_DIRECT.get(kind, pattern), text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules: tuple):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, rules)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, kind)], names=["blob", "spans"])

    return run


def _ledger(spark, path: str, version: str) -> DataFrame:
    """What the ledger holds for this version of the rules; nothing if it has not been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rules={version}")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(_FOUND).parquet(f"{path}/rules={version}")
    return spark.createDataFrame([], _FOUND)


def scan(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES, ledger: str | None = None) -> tuple[DataFrame, str]:
    """Every row of ``versions`` as (id, blob, spans), and the path of the ledger.

    ``ledger`` names one written before, which is extended by the blobs not yet in it; else a new one is
    begun in the shared folder. A null text is the empty text. Rows of equal text share one finding,
    whatever their ids; null and repeated ids are allowed. Spans are ordered by start, then in the order
    of the rules. Very long texts are scanned whole. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = versions.sparkSession
    prepare(spark)
    ledger = ledger or f"{work_dir(spark)}/ledger-{uuid.uuid4().hex}"
    version = rules_version(rules)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = versions.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = texts.select("id", "blob")
    known = _ledger(spark, ledger, version)
    blobs = paths.groupBy("blob").agg(F.min("id").alias("rep"), F.count("*").alias("paths"))
    total = versions.count()
    one = blobs.join(known.select("blob"), "blob", "left_anti").select(F.col("blob").alias("new"), "rep")
    doubtful = blobs.where("paths > 1").select("blob").unionAll(blobs.join(known.select("blob"), "blob", "left_semi").select("blob"))
    sorted_out = sieved(texts, F.col("blob"), doubtful, F.col("blob"), total, "doubtful")
    alone, others = sorted_out.where("not doubtful").select("blob", "text"), sorted_out.where("doubtful")
    chosen = others.join(one, (others["blob"] == one["new"]) & others["id"].eqNullSafe(one["rep"]), "left_semi").select("blob", "text")
    found = alone.unionAll(chosen).mapInArrow(_scan(rules), _FOUND).dropDuplicates(["blob"])
    found.write.mode("append").parquet(f"{ledger}/rules={version}")
    held = _ledger(spark, ledger, version)
    return join_unique(paths, blobs.join(held, "blob"), ["blob"], "paths", total, blobs).select("id", "blob", "spans"), ledger


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``[kind]``; overlapping spans become one.
    Texts that certainly hold none are not shuffled.

    Rows without findings, null and empty texts and other columns stay as they are, whatever their
    names; repeated rows stay repeated and are changed alike; very long texts are changed whole. An empty
    table gives an empty result.
    """
    blob, found, flag = (free(docs.columns, x) for x in ("blob", "spans", "flag"))
    spans, _ = scan(docs, id_col, text_col, rules)
    text = F.col(f"`{text_col}`")
    hits = Saved(spans.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(found), F.count("*").alias(f"{blob}s")), "hits").df
    total = docs.count()
    rows = sieved(docs.withColumn(blob, F.sha2(text, 256)), F.col(blob), hits, F.col(blob), total, flag)
    joined = join_unique(rows.where(F.col(flag)), hits, [blob], f"{blob}s", total)
    step = lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["done"], F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")).alias("done"),
            x["end"].alias("at"),
        )
    )
    clean = F.aggregate(found, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = joined.select(*(F.when(F.col(found).isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    return rows.where(~F.col(flag)).select(*(F.col(f"`{c}`") for c in docs.columns)).unionAll(changed)


def op10_secret_scan(spark, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document.

    ``ledger`` is that of earlier runs, of which only what is new is scanned; without one, a run has a
    ledger of its own in the application's folder.
    """
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ledger=ledger)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin([r[0] for r in BASE]))
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
