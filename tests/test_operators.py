"""Operators on small literal inputs, against plain models and by their invariants."""

from __future__ import annotations

import io
import math
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packlens.functions import numbers, paths
from packlens.functions.binary import blake3, entropy_millibits
from packlens.operators import cachesim, cas, chunking, library, ranges, sequence, trace, tree, validity
from packlens.sources import documents, index, windows, zipfiles

READS = "seq long, session string, worker string, path string, offset long, requested long, returned long, ts_ns long, op string, success boolean, cache string, source string, latency_ns long"


def events(spark, rows):
    """(path, offset, returned, ms) as reads in order."""
    full = [(i, "s", "w", p, o, n, n, ms * 1_000_000, "read", True, "hit", "x", 10 * i) for i, (p, o, n, ms) in enumerate(rows)]
    return spark.createDataFrame(full, READS)


def test_blake3_vectors():
    empty, abc = blake3([b"", b"abc"])
    assert (empty[:8], empty[-4:]) == ("af1349b9", "3262")
    assert (abc[:8], abc[-4:]) == ("6437b3ac", "9d85")
    items = [bytes(i % 251 for i in range(n)) for n in (1024, 1025, 3000, 7000)]
    assert blake3(items) == [blake3([x])[0] for x in items]
    assert blake3([]) == []


def test_paths(spark):
    bad = ["../escape", "/root", "a//b", "C:/foo", "a\\b", "a/../b", "a\0", "", ".", "a/", "a/."]
    good = ["a", "a/b.c", "...", "a/..b", "日本/é"]
    rows = spark.createDataFrame([(p,) for p in bad + good], "path string")
    got = {r["path"]: r["v"] for r in rows.withColumn("v", paths.valid_path(F.col("path"))).collect()}
    assert got == {p: False for p in bad} | {p: True for p in good}
    assert all(paths.is_valid_path(p) == v for p, v in got.items())
    one = spark.createDataFrame([("a/b/c", "a", "x")], "p string, o string, n string")
    r = one.select(paths.parent(F.col("p")), paths.base_name(F.col("p")), paths.ancestors(F.col("p")), paths.moved(F.col("p"), F.col("o"), F.col("n")), paths.overlaps(F.col("p"), F.col("o"))).first()
    assert tuple(r) == ("a/b", "c", ["a", "a/b"], "x/b/c", True)


def test_sequence_detector(spark):
    overlap = [("f", 0, 8, 0), ("f", 4, 8, 1), ("f", 8, 8, 2), ("f", 8, 8, 3), ("f", 100, 1, 4)]
    r = sequence.sequences(events(spark, overlap), 500).orderBy("seq").collect()
    assert [x["forward_bytes"] for x in r] == [8, 12, 16, 8, 1]
    assert [x["sequential"] for x in r] == [False, False, True, False, False]
    kib = 1024
    windows_ = [("f", i * 64 * kib, 128 * kib, i) for i in range(3)] + [("f", 128 * kib, 128 * kib, 4), ("f", 0, 128 * kib, 5), ("f", 999 * kib, 8, 6), ("g", 0, 8, 7)]
    assert [x["sequential"] for x in sequence.sequences(events(spark, windows_), 500).orderBy("seq").collect()] == [False, False, True, False, False, False, False]
    late = [("f", 0, 8, 0), ("f", 8, 8, 501), ("f", 16, 8, 400), ("f", 24, 8, 900)]  # a clock that steps back does not break
    assert [x["confidence"] for x in sequence.sequences(events(spark, late), 500).orderBy("seq").collect()] == [1, 1, 2, 3]


def test_decay_and_policy(spark):
    assert spark.range(1).select(sequence.decayed(F.lit(64), F.lit(128), 64)).first()[0] == 16
    assert spark.range(1).select(sequence.decayed(F.lit(64), F.lit(10**9), 0)).first()[0] == 0
    assert not sequence.Policy().violations()
    odd = sequence.Policy(ttl_ms=0, eviction="fifo", files={"../x": 5})
    assert odd.violations() == ["ttl_ms", "eviction", "files"]
    steady = events(spark, [("f", i * 65536, 131072, i) for i in range(3)])
    assert sequence.optimize(steady).enabled and sequence.optimize(steady).files == {"f": 3}
    assert not sequence.optimize(events(spark, [("f", o, 4096, i) for i, o in enumerate((9000000, 0, 5000000))])).enabled


def test_trace_summary_of_nothing_and_of_many(spark):
    empty = trace.summary(events(spark, [])).first()
    assert (empty["events"], empty["read_bytes"], empty["p99"], empty["cache_hit_ratio"], empty["reread_ratio"]) == (0, 0, 0, 0.0, 0.0)
    n = 110_000
    rows = spark.range(n).select("id", F.col("id").alias("offset")).unionAll(spark.createDataFrame([(n, 90000)], "id long, offset long"))
    many = rows.select(F.col("id").alias("seq"), F.lit("s").alias("session"), F.lit("w").alias("worker"), F.lit("f").alias("path"), "offset", F.lit(4).cast("long").alias("requested"), F.lit(4).cast("long").alias("returned"), F.lit("read").alias("op"), F.lit(True).alias("success"), F.lit("miss").alias("cache"), F.lit("x").alias("source"), F.lit(1).cast("long").alias("latency_ns"))
    s = trace.summary(many).first()
    assert (s["unique_read_ranges"], s["read_bytes"], s["reread_ratio"]) == (n, 440_004, 1 / (n + 1))
    top = trace.hot_ranges(many).first()
    assert (top["offset"], top["events"]) == (90000, 2)


def test_overflow_is_an_error(spark):
    big = events(spark, [("f", 0, 2**63 - 1, 0), ("f", 0, 1, 1)])
    with pytest.raises(Exception, match="(?i)overflow"):
        trace.summary(big).collect()


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_ranges_equal_slices(spark, data):
    text = "".join(random.Random(data.draw(st.integers(0, 99))).choices("abcdef", k=data.draw(st.integers(0, 60))))
    size = data.draw(st.integers(1, 9))
    reads = data.draw(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70)), min_size=1, max_size=6))
    f = spark.createDataFrame([("p", len(text), text)], "path string, size long, content string")
    c = chunking.fixed_chunks(f.select("path", "content"), size, digest=False)
    r = spark.createDataFrame([(i, "p", o, n) for i, (o, n) in enumerate(reads)], "seq long, path string, offset long, len long")
    want = {i: text[o : o + n] for i, (o, n) in enumerate(reads) if text[o : o + n]}
    for resolved in (ranges.resolve(r, f, c), ranges.resolve_fixed(r, f, c, size)):
        assert {x["seq"]: x["text"] for x in ranges.read_ranges(resolved).collect()} == want


def test_read_of_no_file_is_an_error(spark):
    f = spark.createDataFrame([("p", 1)], "path string, size long")
    r = spark.createDataFrame([(0, "q", 0, 1)], "seq long, path string, offset long, len long")
    with pytest.raises(Exception, match="no such file"):
        ranges.clipped(r, f).collect()


def test_interval_in_a_large_file(spark):
    mib = 1 << 20
    chunk = spark.range(12288).select(F.lit("p").alias("path"), F.col("id").alias("ordinal"), (F.col("id") * mib).alias("offset"), F.lit(mib).cast("long").alias("raw_size"))
    f = spark.createDataFrame([("p", 12288 * mib)], "path string, size long")
    r = spark.createDataFrame([(0, "p", 8192 * mib - 1, 2), (1, "p", 12288 * mib, 1)], "seq long, path string, offset long, len long")
    assert sorted(x["ordinal"] for x in ranges.resolve(r, f, chunk).collect()) == [8191, 8192]


def _lru(accesses, capacity):
    """A plain least-recently-used cache."""
    held, out = {}, []
    for key, size in accesses:
        out.append(key in held)
        if key in held:
            held[key] = held.pop(key)
        elif size <= capacity:
            while sum(held.values()) + size > capacity:
                held.pop(next(iter(held)))
            held[key] = size
    return out


def test_lru_forms_agree(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for cache in "ab":
        sizes = {f"o{i}": rng.randint(1, 12) for i in range(9)}
        keys = rng.choices(list(sizes), k=120)
        rows += [(cache, i, k, sizes[k]) for i, k in enumerate(keys)]
        want |= {(cache, i): hit for i, hit in enumerate(_lru([(k, sizes[k]) for k in keys], 11))}
    a = spark.createDataFrame(rows, "cache string, seq long, object string, size long")
    for out in (cachesim.lru_hits(a, 11), cachesim.simulate(a, 11)):
        assert {(x["cache"], x["seq"]): x["hit"] for x in out.collect()} == want


def test_speculation_never_evicts_what_matters_more():
    cache = cachesim.Cache(10, True)
    for _ in range(5):
        cache.access("hot", 6)
    cache.access("cold", 4)
    assert not cache.speculate("next", 8, 2) and "hot" in cache.entries
    assert cache.speculate("small", 4, 2) and "cold" not in cache.entries and "hot" in cache.entries
    assert cache.access("small", 4) and cache.count["prefetch_useful_bytes"] == 4
    scheduler = cachesim.Scheduler(cachesim.Cache(100, True), 20, 2, 50)
    for key in ("a", "a", "b", "c"):
        scheduler.request(key, 10, 1, 0)
    assert scheduler.count == {"requests": 2, "duplicates": 1, "dropped": 1, "expired": 0}
    scheduler.work(60)
    assert scheduler.count["expired"] == 2


def test_gear_chunks_find_again_what_moved(spark):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    for piece in (data, b"", b"x", data[:100]):
        ends = chunking.gear_cuts(piece, 256, 1024, 4096)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(piece) and all(n <= 4096 for n in sizes) and all(n > 256 for n in sizes[:-1])
    files = spark.createDataFrame([("v", bytearray(data))], "path string, content binary")
    moved = spark.createDataFrame([("v", bytearray(b"new" * 50 + data))], "path string, content binary")
    old, new = chunking.content_chunks(files, 1024), chunking.content_chunks(moved, 1024)
    assert cas.version_reuse(old, new).first()["reuse_ratio"] > 0.8
    fixed = [chunking.fixed_chunks(f, 1024) for f in (files, moved)]
    assert cas.version_reuse(*fixed).first()["reuse_ratio"] == 0
    bounded = chunking.content_chunks(files.withColumn("ends", F.array(F.lit(10), F.lit(60_000))), 1024, "ends").orderBy("ordinal")
    assert bounded.first()["raw_size"] == 10 and bounded.agg(F.sum("raw_size")).first()[0] == 60_000


def test_entropy(spark):
    rows = [(b"",), (b"aaaa",), (b"abab",), (bytes(range(256)),)]
    got = [r[0] for r in spark.createDataFrame([(bytearray(x),) for (x,) in rows], "b binary").select(entropy_millibits(F.col("b"))).collect()]
    assert got == [0, 0, 1000, 8000]


def test_index_round_trip_and_damage():
    rows = [{"hash": f"{i:064x}", "pack_id": i, "pack_offset": 8 + i, "compressed_size": 5, "raw_size": 9, "codec": "zstd"} for i in (3, 1, 2)]
    data = index.encode(rows)
    assert index.decode(data) == sorted(rows, key=lambda r: r["hash"])
    flipped = data[:16] + data[72:128] + data[16:72] + data[128:]
    raw = index.encode([rows[0] | {"codec": "raw"}])
    for bad in (b"", data[:-1], data + b"\0", b"X" + data[1:], flipped, raw, data[:-1] + b"\1"):
        with pytest.raises(ValueError):
            index.decode(bad)


def test_zip_record_ends():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(4):
            z.writestr(zipfile.ZipInfo(f"d/{i}"), b"data" * i, compress_type=zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    data = out.getvalue()
    ends = zipfiles.record_ends(data)
    assert len(ends) == 5 and ends[-1] == len(data) and all(data[e : e + 4] in (b"PK\3\4", b"PK\1\2") for e in ends[:-1])
    for bad in (b"", data[1:], data + b"x", b"junk" + data, data.replace(b"d/2", b"../", 1)):
        with pytest.raises((ValueError, struct.error)):
            zipfiles.record_ends(bad)


def test_stream_lists_refuse_lies():
    name = "::$DATA".encode("utf-16-le")
    good = struct.pack("<IIqq", 0, len(name), 5, 4096) + name
    assert windows.parse_streams(good) == [("::$DATA", 5, 4096)]
    for bad in (good[:20], struct.pack("<IIqq", 0, 99, 5, 1) + name, struct.pack("<IIqq", 4, len(name), 5, 1) + name, struct.pack("<IIqq", 0, len(name), -1, 1) + name):
        with pytest.raises(ValueError):
            windows.parse_streams(bad)


def test_strict_json(spark):
    line = '{"version":1,"session":"s","op":"read","path":"a","offset":0,"requested":4,"returned":18446744073709551615,"latency_ns":1,"cache":"hit","source":"x","worker":"w","success":true,"ts_ns":1%s}'
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert int(documents.strict(rows(line % ""), documents.TRACE).first()["returned"]) == 2**64 - 1
    for bad in (line % ',"extra":1', "nonsense", (line % "").replace(":1,", ":2,", 1), (line % "").replace('"a"', '"' + "a" * 300_000 + '"')):
        with pytest.raises(Exception, match="unknown key|JSON|version|too long"):
            documents.strict(rows(bad), documents.TRACE).collect()


def test_receipts_refuse_what_is_unsafe(spark):
    import json

    good = {"record": {"game_identifier": "g-1", "launch_target": "bin/x", "launcher_type": "plain", "status": "Tested", "evidence": [], "limitations": []}, "source_before_hash": "a", "source_after_hash": "a", "pass_fail": "PASS"}

    def read(**change):
        one = good | {k: v for k, v in change.items() if k in good} | {"record": good["record"] | {k: v for k, v in change.items() if k not in good}}
        text = json.dumps({"schema": 1, "commit_SHA": "c", "records": [one] * change.get("times", 1), "pass_fail": "PASS"}) if "times" not in change else json.dumps({"schema": 1, "commit_SHA": "c", "records": [good] * change["times"], "pass_fail": "PASS"})
        return documents.receipt_rows(documents.strict(spark.createDataFrame([(text,)], "value string"), documents.RECEIPT, version=None)).collect()

    assert [tuple(r) for r in read()] == [("c", "g-1", "bin/x", "plain", "Tested", True)] and len(read(times=128)) == 128
    for change in ({"game_identifier": "a/b"}, {"launch_target": "../x"}, {"launch_target": "/x"}, {"launcher_type": "script"}, {"status": "Fine"}, {"source_after_hash": "b"}, {"times": 129}):
        with pytest.raises(Exception):
            read(**change)


def test_swap_in_keeps_the_last_table(spark, tmp_path):
    path = f"file://{tmp_path}/library"
    for n in (1, 2, 3):
        documents.swap_in(spark.range(n), path)
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(f"{path}.backup").count() == 2
    with pytest.raises(Exception):
        documents.write_new(spark.range(1), path)


def test_process_members(spark):
    rows = spark.createDataFrame([(100, 1, 1, 100), (101, 2, 100, 100), (102, 3, 101, 9)], "pid long, birth long, parent long, group long")
    known = spark.createDataFrame([], "pid long, birth long")
    first = tree.members(rows, known, 100, (100, 1))
    assert {r["pid"] for r in first.collect()} == {100, 101, 102}
    again = spark.createDataFrame([(101, 2, 1, 5), (102, 3, 1, 9)], "pid long, birth long, parent long, group long")
    second = tree.members(again, first, 100, (100, 1))
    assert {r["pid"] for r in second.collect()} == {101, 102}
    reused = spark.createDataFrame([(100, 9, 1, 100), (105, 1, 100, 100)], "pid long, birth long, parent long, group long")
    assert tree.members(reused, second, 100, (100, 1)).count() == 0


def test_process_members_of_long_chains(spark):
    chain = [(i, i + 7, i - 1, 0) for i in range(1, 501)]
    forks = [(10_000 + i, 1, 10 * i, 0) for i in range(1, 51)]
    twice = [(i, 5, 900_000 + i, 0) for i in range(100, 400, 3)]  # a pid with two rows, one of an unknown parent
    loop = [(20_000 + i, 1, 20_000 + (i + 1) % 300, 0) for i in range(300)]
    rows = spark.createDataFrame([*chain, *forks, *twice, *loop], "pid long, birth long, parent long, group long")
    known = spark.createDataFrame([(101, 108), (20_005, 1), (20_100, 2)], "pid long, birth long")
    got = sorted(tuple(r) for r in tree.members(rows, known, None, None).collect())
    below = {p for p, *_ in chain if p >= 101}
    want = {(p, b) for p, b, *_ in [*chain, *twice] if p in below and (p, b) != (100, 5)} | {(p, b) for p, b, above, _ in forks if above in below} | {(p, b) for p, b, *_ in loop}
    assert got == sorted(want)


def test_validity(spark):
    files = spark.createDataFrame([("a/x", 5), ("b", 0)], "path string, size long")
    chunks = spark.createDataFrame([("a/x", 0, 0, 3), ("a/x", 1, 3, 2)], "path string, ordinal long, offset long, raw_size long")
    assert validity.bad_chunk_tables(files, chunks).isEmpty()
    assert validity.bad_chunk_tables(files, chunks.where("ordinal = 1")).first()["reason"] == "coverage"
    assert [r["path"] for r in validity.missing_ancestors(files, spark.createDataFrame([], "path string")).collect()] == ["a"]
    nodes = spark.createDataFrame([("a", "file"), ("a/x", "file"), ("q/y", "file")], "path string, kind string")
    assert {(r["path"], r["reason"]) for r in validity.bad_tree(nodes).collect()} == {("a/x", "parent is no directory"), ("q/y", "no parent")}


def test_numbers(spark):
    text = {"256K": 1 << 18, "1MiB": 1 << 20, "4G": 1 << 32, "7": 7, "x": None, "": None, "-1": None, "1.5K": None}
    rows = spark.createDataFrame([(t,) for t in text], "t string")
    assert {r[0]: r[1] for r in rows.select("t", numbers.parse_size(F.col("t"))).collect()} == text
    seed = 0x9E3779B97F4A7C15
    states = [s - (1 << 64) if s >> 63 else s for s in numbers.xorshift(seed, 20)]
    got = spark.range(1, 21).select(numbers.xorshift_column(seed, F.col("id"))).collect()
    assert [r[0] for r in got] == states
    shown = spark.createDataFrame([(None,), (0,), (512,), (2048,), (3 << 19,)], "n long").select(numbers.human_bytes(F.col("n")))
    assert [r[0] for r in shown.collect()] == ["Unavailable", "0 B", "512 B", "2 KiB", "1.50 MiB"]


def test_overlapping_paths_need_no_cross_join(spark):
    new = spark.createDataFrame([("a/b",), ("c",), ("ab",)], "path string")
    known = spark.createDataFrame([("a",), ("a/b/c",), ("a/b",), ("a/bc",)], "path string")
    out = library.overlapping(new, known)
    assert {tuple(r) for r in out.collect()} == {("a/b", "a"), ("a/b", "a/b/c"), ("a/b", "a/b")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_prune_and_push_down(spark):
    from helpers import SMALL

    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_quantity > 49").groupBy("l_returnflag").agg(F.sum("l_quantity"))
    plan = lines._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_content_defined_chunks_survive_a_patch(spark):
    from packlens.sources.fixtures import mixed_entropy, two_versions

    old, new = two_versions(400_000)
    a, b = (spark.createDataFrame([("f", bytearray(x))], "path string, content binary") for x in (old, new))
    gear = cas.version_reuse(chunking.content_chunks(a, 2048), chunking.content_chunks(b, 2048)).first()["reuse_ratio"]
    fixed = cas.version_reuse(chunking.fixed_chunks(a, 2048), chunking.fixed_chunks(b, 2048)).first()["reuse_ratio"]
    assert gear > 0.8 > 0.6 > fixed
    assert len(mixed_entropy(4001)) == 4001


def test_store_refuses_damage(spark):
    from packlens.operators import store
    from packlens.sources.fixtures import mixed_entropy

    rows = [("a", bytearray(mixed_entropy(9000))), ("b", bytearray(mixed_entropy(9000))), ("c", bytearray(b"x"))]
    made = store.pack(spark.createDataFrame(rows, "path string, content binary"), 1000, 4000)
    files, chunks, objects = made
    assert {r["path"]: r["size"] for r in store.unpacked_digests(made).collect()} == {"a": 9000, "b": 9000, "c": 1}
    assert objects.count() == chunks.select("hash").distinct().count() < chunks.count()
    assert validity.bad_coverage(objects.withColumn("pack_id", F.xxhash64("shard", "pack_id"))).isEmpty()
    with pytest.raises(Exception, match="missing object"):
        store.unpack(made._replace(objects=objects.where("raw_size > 1"))).collect()
    with pytest.raises(Exception, match="damaged object"):
        store.unpack(made._replace(objects=objects.withColumn("hash", F.reverse("hash")))).collect()
    with pytest.raises(Exception, match="damaged file"):
        store.unpack(made._replace(chunks=chunks.where("path <> 'a' or ordinal <> 2"))).collect()


def test_store_keeps_what_is_empty_and_publishes_what_is_sound(spark, tmp_path):
    from packlens.operators import store

    rows = [("a/x", "file", bytearray(b"abc")), ("a/empty", "file", bytearray()), ("null", "file", None), ("bare/dir", "directory", None), ("b", "file", bytearray(b"abc" * 999))]
    made = store.pack(spark.createDataFrame(rows, "path string, kind string, content binary"), 100)
    path = f"file://{tmp_path}/store"
    got = {r["path"]: (r["kind"], r["content"] and bytes(r["content"]) or r["content"]) for r in store.unpack(store.publish(made, path)).collect()}
    assert got == {p: (k, None if k == "directory" else bytes(c or b"")) for p, k, c in rows}
    with pytest.raises(FileExistsError):
        store.publish(made, path)
    with pytest.raises(Exception, match="missing object"):
        store.publish(made._replace(objects=made.objects.limit(1)), f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists()
    none = store.pack(spark.createDataFrame([], "path string, content binary"), 100)
    assert store.unpack(none).count() == 0


def test_a_sparse_tree_goes_through_a_store(spark):
    from packlens.operators import store
    from packlens.operators.profile import extents
    from packlens.sources.fixtures import sparse_tree

    files = sparse_tree(1 << 20)
    assert files == sparse_tree(1 << 20) != sparse_tree(1 << 20, seed=1)
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    made = store.pack(df, 1 << 16)
    assert {r["path"]: bytes(r["content"]) for r in store.unpack(made).collect()} == files
    assert made.chunks.where("path = 'world.dat'").select("hash").distinct().count() <= 17
    found = df.where("path = 'world.dat'").select(extents(F.col("content"), 4096).alias("e")).first()["e"]
    held = sum(e["end"] - e["start"] for e in found)
    assert 0 < held < 1 << 18 and found[0]["start"] == 0 and found[-1]["end"] == 1 << 20


def test_overlay_commit_checks_sizes(spark):
    from packlens.operators import store

    base = spark.createDataFrame([("d", 2, "directory", 493, 0), ("d/f", 3, "file", 420, 3), ("g", 4, "file", 420, 1)], "path string, id long, kind string, mode int, size long")
    up = spark.createDataFrame([("n", 9, 420, "data", None, 2), ("h", 10, 420, "base", "d/f", 0), ("z", 11, 420, "data", None, 0)], "path string, id long, mode int, kind string, source string, size long")
    dead = spark.createDataFrame([("g",)], "path string")
    content = spark.createDataFrame([("d/f", bytearray(b"xyz")), ("g", bytearray(b"q"))], "path string, content binary")
    written = spark.createDataFrame([("n", bytearray(b"ab"))], "path string, content binary")
    got = {r["path"]: r["content"] and bytes(r["content"]) for r in store.unpack(store.commit(base, up, dead, content, written, 2)).collect()}
    assert got == {"d": None, "d/f": b"xyz", "n": b"ab", "h": b"xyz", "z": bytearray()}
    with pytest.raises(Exception, match="size of its record"):
        store.unpack(store.commit(base, up, dead, content, written.where("false"), 2)).collect()


def test_replays_are_compared_in_turns(spark):
    from packlens.operators import store

    rng = random.Random(2)
    rows = spark.createDataFrame([("c", i, f"o{rng.randrange(9)}", 10) for i in range(80)], "cache string, seq long, object string, size long")
    got = store.compare_replays(rows, 50, 3).orderBy("repetition", "place").collect()
    assert [r["mode"] for r in got] == ["static", "adaptive", "adaptive", "static", "static", "adaptive"] and len({r["served"] for r in got}) == 1
    with pytest.raises(ValueError):
        store.compare_replays(rows, 50, 11)


def test_observer_sees_progress_and_cancels(spark):
    import time

    from packlens.session import Cancelled, observed

    seen = []
    assert observed(spark, lambda: spark.range(1000).repartition(8).count(), lambda *x: seen.append(x) or True, 0.01) == 1000
    assert all(a <= b for a, b in seen)

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    start = time.time()
    with pytest.raises(Cancelled):
        observed(spark, lambda: spark.range(4).mapInArrow(slow, "id long").count(), lambda *x: time.time() - start < 1, 0.1)
    assert time.time() - start < 40


def test_library_changes_are_checked(spark):
    entries = spark.createDataFrame([("a", "lib/a", "s", True, None, "running")], "id string, source string, store string, verified boolean, error string, session string")
    for source in ("lib/a", "lib", "lib/a/b", "store/x"):
        with pytest.raises(ValueError):
            library.add(entries, spark.createDataFrame([("n", source)], "id string, source string"), "store")
    assert library.add(entries, spark.createDataFrame([("n", "lib/ab")], "id string, source string"), "store").count() == 2
    with pytest.raises(ValueError):
        library.remove(entries, "b")
    none = entries.select("store").where("false")
    seen = library.loaded(entries, entries.select("source"), none)
    assert tuple(seen.first()) == ("a", "lib/a", "s", False, "store missing or incomplete", "needs_attention")
    assert tuple(library.forget_stores(seen, none).first()) == ("a", "lib/a", None, False, None, "needs_attention")
    assert tuple(library.loaded(entries, none.withColumnRenamed("store", "source"), entries.select("store")).first()) == ("a", "lib/a", "s", True, "source missing", "needs_attention")


def test_a_writer_that_fails_drops_the_rest(spark):
    rows = [(i, "s" * (1 if i % 5 else 99), "w", "p", "read", "hit", "x") for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, session string, worker string, path string, op string, cache string, source string")
    got = {r["period"]: r for r in trace.accounting(df, 10, 47).collect()}
    assert all(r["seen"] == r["written"] + r["dropped"] and r["conserved"] for r in got.values()) and sum(r["seen"] for r in got.values()) == 100
    assert [got[p]["writer_errors"] for p in range(5)] == [0, 0, 1, 0, 0] and got[3]["written"] == got[4]["written"] == 0
    assert got[2]["written"] == sum(1 for i in range(40, 47) if i % 5) and got[0]["queue_high_watermark"] == 8  # two are too long


def test_a_cache_with_a_loader(spark):
    loads = []

    def loader(key):
        loads.append(key)
        if key == "bad":
            raise OSError(key)
        return key.encode() * 3, "remote-http" if key > "b" else "primary-local"

    cache = cachesim.LoadingCache(10, False)
    assert [cache.get(k, loader) for k in ("a", "c", "a")] == [(b"aaa", "primary-local"), (b"ccc", "remote-http"), (b"aaa", "memory-cache")]
    with pytest.raises(OSError):
        cache.get("bad", loader)
    assert list(cache.entries) == ["c", "a"] and cache.by_source == {"primary-local": 1, "remote-http": 1} and cache.count["raw_bytes_loaded"] == 6
    cache.get("dd", loader)  # six bytes more than there is room for: the oldest goes
    assert set(cache.held) == set(cache.entries) == {"a", "dd"} and loads == ["a", "c", "bad", "dd"]


def test_planned_reads_are_inside_their_files(spark):
    from packlens.operators.ranges import planned_reads

    files = spark.createDataFrame([("a", 100), ("b", 0), ("c", 5_000_000)], "path string, size long")
    got = planned_reads(files, 60).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in planned_reads(files, 60).orderBy("seq").collect()]
    sizes = {"a": 100, "c": 5_000_000}
    assert all(r["offset"] >= 0 and r["offset"] + r["len"] <= sizes[r["path"]] and r["len"] == min(sizes[r["path"]], (4096, 65536, 1048576)[i % 3]) for i, r in enumerate(got))
    with pytest.raises(ValueError):
        planned_reads(files.where("size = 0"), 3)


def test_extents(spark):
    from packlens.operators.profile import extents

    texts = [b"", bytes(10), b"abcd" + bytes(9) + b"x", b"a" * 9, bytes(4) + b"b", b"a" + bytes(7) + b"bc" + bytes(20)]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, t binary")
    got = {r[0]: [tuple(x) for x in r[1]] for r in rows.select("i", extents(F.col("t"), 4)).collect()}
    assert got == {0: [], 1: [], 2: [(0, 4), (12, 14)], 3: [(0, 9)], 4: [(4, 5)], 5: [(0, 4), (8, 12)]}


def test_ranges_meet_once(spark):
    from packlens.operators.ranges import meeting

    rng = random.Random(3)
    some = lambda n: [(rng.choice("pq"), i, (a := rng.randrange(500)), a + rng.randrange(90)) for i in range(n)]
    left, right = some(60), some(60)
    l, r = spark.createDataFrame(left, "path string, i int, a long, b long"), spark.createDataFrame(right, "path string, j int, c long, d long")
    got = sorted((x["i"], x["j"]) for x in meeting(l, ("a", "b"), r, ("c", "d"), span=16).collect())
    assert got == sorted((i, j) for p, i, a, b in left for q, j, c, d in right if p == q and a < b and c < d and a < d and c < b)


def test_heat_by_spans(spark):
    from packlens.operators import sequence

    rng = random.Random(9)
    paths = [rng.choice("aaaaaaabbc") for _ in range(1500)]
    reads = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, seq long")
    want = {}
    for epoch, p in enumerate(paths, 1):
        score, last = want.get(p, (0, epoch))
        want[p] = (min(1024, (score >> min(31, (epoch - last) // 3)) + 1), epoch)
    for span in (1 << 20, 40):
        assert {r["path"]: (r["heat"], r["epoch"]) for r in sequence.heat(reads, 3, span).collect()} == want


def test_nearest_ranks(spark):
    from packlens.operators.trace import nearest_ranks

    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(50)])) for _ in range(700)] + [("z", 5), ("w", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    rank = lambda values, p: sorted(values)[max(1, -(-len(values) * p // 100)) - 1]
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in nearest_ranks(df, ["g"], "v").collect()} == {g: tuple(rank(v, p) for p in (50, 95, 99)) for g, v in by.items()}
    whole = [v for _, v in rows if v is not None]
    assert tuple(nearest_ranks(df, [], "v").first()) == tuple(rank(whole, p) for p in (50, 95, 99))


def _plain_gear(data, least, average, most):
    """The chunker as it is told, a byte at a time."""
    bits = max(1, round(math.log2(average)))
    ends, at = [], 0
    while len(data) - at > least:
        roll, end = 0, min(at + most, len(data))
        for i in range(at + least, end):
            roll = (2 * roll + chunking.GEAR[data[i]]) % 2**64
            if roll % 2 ** (bits + 1 if i < at + average else max(1, bits - 1)) == 0:
                end = i + 1
                break
        ends.append(end)
        at = end
    return ends + ([len(data)] if at < len(data) else [])


def test_gear_cuts_equal_a_plain_loop():
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choices(rng.choice((b"a", b"ab", bytes(range(256)))), k=rng.choice((0, 1, 7, 300, 5000))))
        least, average = rng.randint(1, 60), rng.randint(60, 300)
        most = average + rng.randint(0, 600)
        assert chunking.gear_cuts(data, least, average, most) == _plain_gear(data, least, average, most)


def test_speculation_keeps_to_the_number_of_entries(monkeypatch):
    monkeypatch.setattr(cachesim, "MOST_ENTRIES", 8)
    cache = cachesim.Cache(100, True)
    for i in range(8):
        cache.access(i, 1, 100)
    assert not cache.speculate("next", 1, 1) and len(cache.entries) == 8 and cache.count["evictions"] == 0 and cache.count["prefetch_skipped"] == 1
    assert cache.speculate("next", 1, 200) and len(cache.entries) == 8 and cache.count["evictions"] == 1


class _PlainCache:
    """A cache as it is told: a list from the oldest on, searched anew for each victim."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.rows, self.epoch = capacity, most, [], 0
        self.count = dict.fromkeys(cachesim.Cache.COUNTERS, 0)

    def score(self, r):
        return r["priority"] >> min(31, (self.epoch - r["epoch"]) // 64)

    def held(self, rows):
        return sum(r["size"] for r in rows)

    def drop(self, rows):
        for r in rows:
            self.rows = [x for x in self.rows if x is not r]
            self.count["evictions"] += 1
            self.count["prefetch_wasted_bytes"] += r["size"] if r["ahead"] else 0

    def put(self, key, size, priority, ahead):
        self.rows.append({"key": key, "size": size, "priority": priority, "epoch": self.epoch, "ahead": ahead})
        self.count["raw_bytes_loaded"] += size if ahead else 0
        self.count["peak_bytes"] = max(self.count["peak_bytes"], self.held(self.rows))

    def worst(self, rows):
        return min(rows[:64], key=self.score)

    def access(self, key, size, priority):
        self.epoch += 1
        for r in self.rows:
            if r["key"] == key:
                self.count["hits"] += 1
                self.count["prefetch_useful_bytes"] += r["size"] if r["ahead"] else 0
                r.update(priority=max(self.score(r) + 1, priority), epoch=self.epoch, ahead=False)
                self.rows = [x for x in self.rows if x is not r] + [r]
                return
        self.count["misses"] += 1
        self.count["raw_bytes_loaded"] += size
        if 0 < size <= self.capacity:
            while self.held(self.rows) + size > self.capacity or len(self.rows) >= self.most:
                self.drop([self.worst(self.rows)])
            self.put(key, size, priority, False)

    def speculate(self, key, size, priority):
        left, victims = list(self.rows), []
        good = 0 < size <= self.capacity and all(r["key"] != key for r in left)
        while good and (self.held(left) + size > self.capacity or len(left) >= self.most):
            good = len(victims) < 64 and bool(left) and self.score(self.worst(left)) <= priority
            if good:
                victims.append(self.worst(left))
                left = [x for x in left if x is not victims[-1]]
        if not good:
            self.count["prefetch_skipped"] += 1
            return
        self.drop(victims)
        self.count["prefetch_loaded_bytes"] += size
        self.put(key, size, priority, True)


def test_adaptive_cache_equals_a_plain_model(monkeypatch):
    monkeypatch.setattr(cachesim, "MOST_ENTRIES", 90)
    for seed in range(6):
        rng = random.Random(seed)
        cache, plain = cachesim.Cache(400, True), _PlainCache(400, 90)
        for _ in range(1500):
            key, size, priority = rng.randrange(300), rng.choice((1, 2, 3, 9, 40, 500)), rng.randrange(6)
            if rng.random() < 0.7:
                cache.access(key, size, priority)
                plain.access(key, size, priority)
            else:
                cache.speculate(key, size, priority)
                plain.speculate(key, size, priority)
        assert cache.count == plain.count and list(cache.entries) == [r["key"] for r in plain.rows]


def test_overlay_directories(spark):
    from packlens.operators import overlay

    base = spark.createDataFrame([("d", 2, "directory", 493, 0), ("d/f", 3, "file", 420, 5)], "path string, id long, kind string, mode int, size long")
    up = spark.createDataFrame([], "path string, id long, mode int, kind string, source string, size long")
    dead = spark.createDataFrame([], "path string")
    with pytest.raises(ValueError):
        overlay.remove_directory(base, up, dead, "d")
    up, dead = overlay.remove(base, up, dead, "d/f")
    up, dead = overlay.remove_directory(base, up, dead, "d")
    up, dead = overlay.make_directories(up, dead, spark.createDataFrame([("e", 9, 493)], "path string, id long, mode int"))
    assert [(r["path"], r["kind"]) for r in overlay.merge(base, up, dead).collect()] == [("e", "directory")]
    assert {r["path"] for r in dead.collect()} == {"d", "d/f"}


def test_http_ranges(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from packlens.sources import remote

    data, tries = bytes(range(200)), []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            start, end = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            body, status, total, extra = data[start : end + 1], 206, len(data), {}
            tries.append(self.path)
            if self.path == "/missing":
                status, body = 404, b""
            elif self.path == "/flaky" and tries.count("/flaky") < 2:
                status, body = 503, b""
            elif self.path == "/whole":
                status = 200
            elif self.path == "/short":
                body = body[:-1]
            elif self.path == "/total":
                total += 1
            elif self.path == "/gzip":
                extra = {"Content-Encoding": "gzip"}
            self.send_response(status)
            self.send_header("Content-Range", f"bytes {start}-{end}/{total}")
            self.send_header("Content-Length", str(len(body)))
            for k, v in extra.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    names = ["good", "missing", "flaky", "whole", "short", "total", "gzip"]
    wanted = spark.createDataFrame([(n, f"{base}/{n}", 10, 5, 200) for n in names] + [("gone", "http://127.0.0.1:1/x", 0, 1, 1)], "hash string, url string, start long, size long, total long")
    got = {r["hash"]: r for r in remote.fetch_objects(wanted, retries=1, timeout=2.0).collect()}
    server.shutdown()
    assert {k: r["status"] for k, r in got.items()} == {"good": "ok", "missing": "not found", "flaky": "ok", "whole": "corrupt", "short": "corrupt", "total": "corrupt", "gzip": "corrupt", "gone": "unavailable"}
    assert bytes(got["good"]["payload"]) == data[10:15] and (got["flaky"]["requests"], got["flaky"]["errors"]) == (2, 1) and got["gone"]["requests"] == 2


def test_scanned_files_are_bounded(spark, tmp_path, monkeypatch):
    """A source's texts are many files, whatever their bytes; odd names and empty texts stay."""
    from packlens.plans import formats

    text = F.when(F.col("id") % 10 == 0, "").otherwise(F.repeat(F.lit("ab"), 15_000))
    hot = spark.range(500).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    odd = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate([("é", "a b:%=c"), ("", "blank"), ("", "blank"), (None, "none"), ("x", "")])], "doc_id long, text string, lang string, source string")
    hot.unionAll(odd).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(formats, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    got = {r["directory"]: (r["files"], r["bytes"]) for r in formats.tree_scan(spark, str(tmp_path)).collect()}
    assert got == {"hot": (500, 450 * 30_000), "a b:%=c": (1, 2), "blank": (2, 0), "none": (1, None), "": (1, 1)}
    sizes = [r["size"] for r in documents.scan_tree(spark, f"file://{tmp_path}/tree").collect() if r["path"].startswith("directory=")]
    assert len(sizes) > 6 and max(sizes) < 8 << 20
