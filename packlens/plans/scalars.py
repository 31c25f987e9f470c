"""Queries that apply the scalar functions to columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary, numbers, paths
from ..sources.adapters import FILES, PAGE_PATHS, files, page_paths
from .register import query, table


@query(f"""WITH {PAGE_PATHS} SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '([^/]*)$', 1) AS name,
lower(regexp_extract(path, '([^.]*)$', 1)) AS extension, array_to_string([array_to_string(string_split(path, '/')[1:i], '/') for i in range(1, len(string_split(path, '/')))], '|') AS ancestors,
'new/root' || substr(path, length(split_part(path, '/', 1)) + 1) AS moved, starts_with(path, split_part(path, '/', 1) || '/') AS below FROM page_paths""")
def path_functions(spark, sf_dir):
    p, top = F.col("path"), F.substring_index("path", "/", 1)
    return page_paths(spark, sf_dir).select(
        "path", paths.parent(p).alias("parent"), paths.base_name(p).alias("name"), paths.extension(p).alias("extension"), F.array_join(paths.ancestors(p), "|").alias("ancestors"),
        paths.moved(p, top, F.lit("new/root")).alias("moved"), paths.is_below(p, top).alias("below"))


@query("""WITH s AS (SELECT page_id, page_id || (['', 'K', 'kb', 'MiB', 'G', 'gib', 'x', 'M B'])[page_id % 8 + 1] AS t FROM pages)
SELECT page_id, t, CASE page_id % 8 WHEN 0 THEN page_id WHEN 1 THEN page_id * 1024 WHEN 2 THEN page_id * 1024 WHEN 3 THEN page_id * 1048576 WHEN 4 THEN page_id * 1073741824 WHEN 5 THEN page_id * 1073741824 END AS bytes FROM s""")
def size_parser(spark, sf_dir):
    units = F.array(*map(F.lit, ("", "K", "kb", "MiB", "G", "gib", "x", "M B")))
    t = F.concat(F.col("page_id").cast("string"), F.element_at(units, (F.col("page_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).withColumn("bytes", numbers.parse_size(F.col("t")))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars * power(2, doc_id % 5 * 8)::BIGINT * (doc_id % 3) END AS n FROM documents),
p AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS place FROM n)
SELECT doc_id, n, CASE WHEN n IS NULL THEN 'Unavailable' WHEN n = 0 THEN '0 B' ELSE CASE WHEN place > 1 THEN printf('%.2f', round(n / power(1024::DOUBLE, place), 2)) ELSE printf('%.0f', round(n / power(1024::DOUBLE, place))) END || ' ' || (['B', 'KiB', 'MiB', 'GiB', 'TiB'])[place + 1] END AS shown FROM p""")
def human_sizes(spark, sf_dir):
    i = F.col("doc_id")
    n = F.when(i % 13 != 0, F.col("n_chars") * F.expr("shiftleft(1L, cast(doc_id % 5 * 8 as int))") * (i % 3))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).withColumn("shown", numbers.human_bytes(F.col("n")))


@query(f"""WITH {FILES}, h AS (SELECT doc_id, sha256(content) AS d FROM files)
SELECT doc_id, upper(d) AS hex, ('0x' || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::BIGINT::DECIMAL(20, 0) AS u32,
('0x' || substr(d, 11, 2) || substr(d, 9, 2))::BIGINT::DECIMAL(20, 0) AS u16, true AS valid, false AS upper_valid FROM h""")
def byte_functions(spark, sf_dir):
    d = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("d")).withColumn("b", F.unhex("d"))
    return d.select("doc_id", F.hex("b").alias("hex"), binary.little_endian(F.col("b"), 1, 4).alias("u32"), binary.little_endian(F.col("b"), 5, 2).alias("u16"), paths.valid_hash(F.col("d")).alias("valid"), paths.valid_hash(F.upper("d")).alias("upper_valid"))


@query("""SELECT o_orderkey, o_orderkey >> least(31, o_custkey // 64) AS decayed, (o_orderkey + 511) // 512 AS blocks, o_orderkey & (o_orderkey - 1) = 0 AS power,
CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderkey > 0 THEN (o_orderkey - o_custkey) / o_orderkey * 100 END AS savings, least(2048, o_orderkey + coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey END, 0)) AS priority,
(o_orderkey + ((o_orderkey + 65535) // 65536 + o_custkey) * 1024 + o_custkey * 16384 + 67108864) * 2 AS budget FROM orders WHERE o_orderkey > 0""")
def number_functions(spark, sf_dir):
    from ..operators.sequence import decayed, read_priority

    n, c = F.col("o_orderkey"), F.col("o_custkey")
    known = F.when(c % 3 > 0, c)
    rows = table(spark, sf_dir, "orders").where("o_orderkey > 0")
    return rows.select(
        "o_orderkey", decayed(n, c, 64).cast("long").alias("decayed"), numbers.divide_up(n, 512).alias("blocks"), numbers.power_of_two(n).alias("power"),
        numbers.savings(n, known).alias("savings"), read_priority(n, known).alias("priority"), numbers.disk_budget(n, c, 262144, False, 2).alias("budget"))


_DRAWS = f"""RECURSIVE states AS (SELECT 0 AS i, 11400714819323198485::HUGEINT AS x UNION ALL
  SELECT i + 1, xor(c, (c << 17) & {numbers.MASK}::HUGEINT) FROM (SELECT i, xor(b, b >> 7) AS c FROM (SELECT i, xor(x, (x << 13) & {numbers.MASK}::HUGEINT) AS b FROM states WHERE i < 64))
), draws AS (SELECT i, (CASE WHEN x > {numbers.MASK >> 1} THEN x - {numbers.MASK}::HUGEINT - 1 ELSE x END)::BIGINT AS draw FROM states)"""


@query(f"""WITH {_DRAWS}, {FILES}, b AS (SELECT path, size, draw, ([{", ".join(map(str, numbers.BORDERS))}, greatest(0, size - 37), size, size + 1])[doc_id % 16 + 1] AS border FROM files JOIN draws ON i = doc_id % 64 + 1)
SELECT path, size, draw, CASE WHEN border <= size + 1 THEN border ELSE (draw % greatest(1, size) + greatest(1, size)) % greatest(1, size) END AS "offset" FROM b""")
def xorshift_offsets(spark, sf_dir):
    """Drawn and border offsets of read probes."""
    d = files(spark, sf_dir).select("path", "size", "doc_id")
    draw = numbers.xorshift_column(0x9E3779B97F4A7C15, F.col("doc_id") % 64 + 1)
    return d.withColumn("draw", draw).withColumn("offset", numbers.probe_offset(F.col("doc_id") % 16, F.col("size"), F.col("draw"))).select("path", "size", "draw", "offset")


@query("""SELECT event_id, user_id <> 3 AND user_id % 7 > 0 AND value <= 300 AS safe FROM events""")
def query_safety(spark, sf_dir):
    path = F.when(F.col("user_id") == 3, "a/../b").when(F.col("user_id") % 7 == 0, "a\\b").otherwise("a/b..c")
    length = F.when(F.col("value") > 300, (16 << 20) + 1).otherwise(4096)
    return table(spark, sf_dir, "events").select("event_id", paths.safe_query(path, length, F.lit(0)).alias("safe"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN left(text, 30) WHEN 1 THEN 'key-' || doc_id WHEN 2 THEN 'a/b' WHEN 3 THEN '' WHEN 4 THEN 'tab' || chr(9) || 'x' ELSE repeat('é', 10 + doc_id % 40) END AS s FROM documents)
SELECT doc_id, coalesce(strlen(s) BETWEEN 1 AND 64 AND NOT regexp_matches(s, '[\x00-\x1f\x7f\x{80}-\x{9f}/\\]'), false) AS label, coalesce(regexp_full_match(s, '[A-Za-z0-9-]{1,64}'), false) AS key FROM t""")
def text_validity(spark, sf_dir):
    """Which texts can be labels and which keys."""
    i = F.col("doc_id")
    odd = F.when(i % 6 == 0, F.left("text", F.lit(30))).when(i % 6 == 1, F.concat(F.lit("key-"), i)).when(i % 6 == 2, "a/b").when(i % 6 == 3, "").when(i % 6 == 4, "tab\tx").otherwise(F.repeat(F.lit("é"), (10 + i % 40).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", odd.alias("s")).select("doc_id", paths.valid_text(F.col("s"), 64).alias("label"), paths.valid_key(F.col("s")).alias("key"))
