"""A deterministic sharded WARC writer and its reader.

Records are built and compressed where their pages are read, range-sorted by page id into shards whose
bounds come from a hash-chosen sample of PER_SHARD ids a shard, put in order by ranges, and written one gzip member a record; a file is
closed when its compressed size passes the limit. Each task writes under a temporary name and returns a
manifest row; only files whose rows were committed get their final names, so attempts that were lost or
repeated leave nothing behind but temporaries, which are removed. Payloads of at least LEAST bytes that
occur more than once are stored once, with the largest page id; the others become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import Saved, parts, prepare, remove, work_dir

LEAST, ROLL_BYTES, SHARD_BYTES, PER_SHARD = 1000, 32 << 20, 16 << 20, 32
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, temporary string, bytes long, sha256 string, records long, first_id long, last_id long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, sha: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{sha}'.encode()).digest()[:16], version=4)}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member with no time and no name, so that equal records are equal bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _common(kind: str, page_id, url: str | None, sha: str, length: int, block: bytes) -> list[tuple[str, str]]:
    where = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:x-page:none"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, f"{kind}:{sha}")), ("WARC-Date", DATE), ("WARC-Target-URI", where), ("Content-Type", "application/http; msgtype=response")]
    headers += [("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"), ("WARC-Payload-Digest", f"sha1:{_base32(bytes.fromhex(sha))}"), ("X-Payload-Length", str(length))]
    return headers + ([("X-Page-Id", str(page_id))] if page_id is not None else [])


def response(page_id, url: str | None, payload: bytes, sha: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _member(_common("response", page_id, url, sha, len(payload), block), block)


def revisit(page_id, url: str | None, sha: str, length: int, refers_to: int) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = _common("revisit", page_id, url, sha, length, block)
    return _member([*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, f"response:{sha}")), ("X-Refers-To-Page", str(refers_to))], block)


def warcinfo(name: str) -> bytes:
    block = b"software: packlens\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}")], block)


_ROWS = "page_id long, sha string, kind int, refers_to long, url string, n long, member binary"


def _bounds(ids: DataFrame, shards: int, many: int) -> list[int]:
    """The least ids of all shards but the first: eight bytes for each SHARD_BYTES of pages."""
    if shards == 1:
        return []
    sample = ids.where("page_id is not null").where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, many // (shards * PER_SHARD)))) == 0).distinct()
    placed = numbered(sample, ["page_id"], "at", 0)
    return sorted(r[0] for r in placed.where((F.col("at") % PER_SHARD == 0) & (F.col("at") > 0)).select("page_id").collect())


def _build(batches):
    for batch in batches:
        ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        payloads = batch.column("payload").cast(pa.binary()).to_pylist()
        digests = [hashlib.sha1(p).hexdigest() for p in payloads]
        size, none = len(ids), [None] * len(ids)
        columns = [pa.array(ids, pa.int64()), pa.array(digests), pa.array([1] * size, pa.int32()), pa.array(none, pa.int64()), pa.array(urls, pa.string()), pa.array([len(p) for p in payloads], pa.int64())]
        members = pa.array([response(i, u, p, d) for i, u, p, d in zip(ids, urls, payloads, digests)], pa.binary())
        yield pa.RecordBatch.from_arrays([*columns, members], names=["page_id", "sha", "kind", "refers_to", "url", "n", "member"])


class _File:
    """An archive being written under a temporary name."""

    def __init__(self, store, root: str, name: str):
        self.name, self.temporary = name, f"_temporary/{uuid.uuid4().hex}-{name}"
        self.out, self.digest, self.bytes, self.records, self.first, self.last = store.open_output_stream(f"{root}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0, None, None
        self.put(warcinfo(name))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)

    def add(self, page_id, member: bytes) -> None:
        self.put(member)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {"name": self.name, "temporary": self.temporary, "bytes": self.bytes, "sha256": self.digest.hexdigest(), "records": self.records, "first_id": self.first, "last_id": self.last}
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))


def _write(target: str, roll: int):
    def run(batches):
        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(f"{root}/_temporary", recursive=True)
        now, shard, at, marked, refers = None, None, 0, None, None
        for batch in batches:
            for own, page_id, sha, kind, to, url, n, member in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "sha", "kind", "refers_to", "url", "n", "member"))):
                if kind == 0:
                    marked, refers = (page_id, sha), to
                    continue
                if now and (own != shard or now.bytes >= roll):
                    yield now.close()
                    now = None
                if now is None:
                    at = at + 1 if own == shard else 0
                    shard, now = own, _File(store, root, f"{own:06d}-{at:05d}.warc.gz")
                now.add(page_id, revisit(page_id, url, sha, n, refers) if marked == (page_id, sha) else member)
        if now:
            yield now.close()

    return run


def _commit(target: str):
    """Gives files their final names; a file that an earlier attempt has moved is left as it is."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes"))):
                if store.get_file_info(f"{root}/{temporary}").type == pafs.FileType.File:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} is not the {size} bytes of the manifest")
            yield batch

    return run


def _sharded(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with the number of bounds that are not above their id (0 for a null id), found by search."""
    held = rows.sparkSession.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

    def run(batches):
        for batch in batches:
            ids = batch.column("page_id")
            shard = np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            yield batch.append_column("shard", pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, shard).astype(np.int64)))

    return rows.mapInArrow(run, f"{_ROWS}, shard long")


def write(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes archives below ``target``, a folder that all executors share; returns the manifest.

    A null html is an empty payload; a null url gets a placeholder; control characters in urls are
    percent-encoded. Null ids come first. Rows that repeat an id and its payload are all written, each
    as a response where that id is the largest. A very long payload is one record, for which its task
    needs a few times its memory. Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    brief = Saved(rows.select("page_id", F.sha1(F.encode("payload", "UTF-8")).alias("sha"), F.octet_length("payload").cast("long").alias("n")), "payloads")
    total, many = brief.df.agg(F.sum("n"), F.count("*")).first()
    shards = parts(total, shard_bytes)
    bounds = _bounds(brief.df.select("page_id"), shards, many)
    heads = brief.df.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("times")).where("times > 1")
    marks = brief.df.where(F.col("n") >= least).join(heads, "sha").where("page_id is null or page_id < refers_to").where("refers_to is not null")
    none = lambda kind: F.lit(None).cast(kind)
    marks = marks.select("page_id", "sha", F.lit(0).alias("kind"), "refers_to", none("string").alias("url"), none("long").alias("n"), none("binary").alias("member")).distinct()
    records = rows.mapInArrow(_build, _ROWS)
    placed = _sharded(records.unionByName(marks), bounds).repartition(shards, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind")
    written = Saved(placed.mapInArrow(_write(target, roll), _MANIFEST), "written")
    manifest = Saved(written.df.repartition(parts(written.df.count(), 16)).mapInArrow(_commit(target), _MANIFEST), "manifest")
    remove(spark, f"{target}/_temporary")
    for done in (brief, written):
        done.drop()
    return manifest.df.drop("temporary")


def members(stream, chunk: int = 1 << 18):
    """The records of an archive, one gzip member at a time, in bounded memory."""
    packed, parts_of = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts_of.append(packed.decompress(data))
            if not packed.eof:
                break
            yield b"".join(parts_of)
            data, packed, parts_of = packed.unused_data, zlib.decompressobj(31), []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4 or headers["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string"


def _read(target: str, payloads: bool):
    def run(batches):
        store, root = pafs.FileSystem.from_uri(target)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "file"]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        headers, block = parse(record)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                        number = lambda key, headers=headers: int(headers[key]) if key in headers else None
                        size = len(payload) if payload is not None else number("X-Payload-Length")
                        rows.append((number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page"), headers["WARC-Target-URI"], payload if payloads else None, name))
                        held += size if payloads else 200
                        if held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return run


def read(manifest: DataFrame, target: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives, every digest checked; payloads only where asked for."""
    files = manifest.select("name")
    return files.repartition(parts(files.count(), 1)).mapInArrow(_read(target, payloads), _READ)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    target = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), target)
    return read(manifest, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), heads AS (
  SELECT digest, max(page_id) AS head FROM payloads WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, payloads.digest AS payload_digest,
       CASE WHEN head IS NOT NULL AND (page_id IS NULL OR page_id < head) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND (page_id IS NULL OR page_id < head) THEN head END AS refers_to
FROM payloads LEFT JOIN heads ON payloads.digest = heads.digest
"""
