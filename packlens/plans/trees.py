"""Queries on directory and process trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import tree as op
from ..sources.adapters import FILES, PAGE_PATHS, files, page_paths
from .register import query, table

_NODES = f"""{PAGE_PATHS}, split AS (SELECT path, string_split(path, '/') AS p FROM page_paths),
dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM split, range(1, 20) r(i) WHERE i < len(p)),
nodes AS (
  SELECT path, 'file' AS kind, size FROM page_paths UNION ALL SELECT path, 'directory', 0 FROM dirs
), tree AS (SELECT path, kind, size, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM nodes)"""


def nodes(spark, sf_dir):
    return op.nodes(page_paths(spark, sf_dir))


@query(f"WITH {_NODES} SELECT parent, path, name, kind FROM tree WHERE parent = '' OR parent IN (SELECT path FROM dirs)")
def tree_children(spark, sf_dir):
    return op.children(nodes(spark, sf_dir))


@query(f"WITH {_NODES} SELECT path, row_number() OVER (ORDER BY path) + 1 AS inode FROM tree")
def inode_numbers(spark, sf_dir):
    return op.inodes(nodes(spark, sf_dir))


@query(f"WITH {_NODES} SELECT parent, name, place FROM (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY name) AS place FROM tree) WHERE place BETWEEN 3 AND 6")
def directory_page(spark, sf_dir):
    return op.page(nodes(spark, sf_dir), 2, 4)


@query(f"""WITH {_NODES} SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') + 1 AS directories, sum(size)::BIGINT AS logical_bytes,
sum((size + 511) // 512)::BIGINT AS blocks FROM tree""")
def namespace_totals(spark, sf_dir):
    return op.totals(nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, inside AS (SELECT parent AS path, count(*) AS n FROM tree WHERE kind = 'directory' GROUP BY parent)
SELECT path, coalesce(n, 0) + 2 AS nlink FROM tree LEFT JOIN inside USING (path) WHERE kind = 'directory'""")
def link_counts(spark, sf_dir):
    return op.link_counts(nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, below AS (SELECT array_to_string(p[1:i], '/') AS path, f.size FROM split JOIN page_paths f USING (path), range(1, 20) r(i) WHERE i < len(p))
SELECT path, count(*) AS files, sum(size)::BIGINT AS bytes FROM below GROUP BY path""")
def subtree_bytes(spark, sf_dir):
    return op.subtree_bytes(nodes(spark, sf_dir))


@query(f"""WITH {FILES} SELECT path, mode, CASE doc_id % 4 WHEN 0 THEN (mode >> 6) & 4 > 0 WHEN 1 THEN (mode >> 3) & 4 > 0 ELSE mode & 4 > 0 END AS readable,
CASE doc_id % 4 WHEN 0 THEN (mode >> 6) & 1 > 0 WHEN 1 THEN (mode >> 3) & 1 > 0 ELSE mode & 1 > 0 END AS runnable, mode & 73 > 0 AS root_runs FROM files""")
def access_bits(spark, sf_dir):
    f = files(spark, sf_dir)
    owner, group = F.when(F.col("doc_id") % 4 == 0, 7).otherwise(8), F.when(F.col("doc_id") % 4 == 1, 70).otherwise(80)
    may = lambda uid=7, gid=70, **k: paths.may_access(F.col("mode"), owner, group, uid, gid, **k)
    return f.select("path", "mode", may(read=True).alias("readable"), may(execute=True).alias("runnable"), may(uid=0, execute=True).alias("root_runs"))


@query("""WITH RECURSIVE procs AS (SELECT conv_id * 10 + turn AS pid, conv_id + turn AS birth, CASE WHEN turn = 0 THEN -1 WHEN turn % 3 = 2 THEN conv_id * 10 + turn - 2 ELSE conv_id * 10 + turn - 1 END AS parent, conv_id AS grp FROM conversations),
known AS (SELECT pid, birth FROM procs WHERE pid % 70 = 0 OR grp = 3), found AS (SELECT pid, birth FROM known UNION SELECT p.pid, p.birth FROM procs p JOIN found f ON p.parent = f.pid)
SELECT DISTINCT pid, birth FROM found""")
def process_closure(spark, sf_dir):
    """Members of a session among processes made of the turns of conversations."""
    c, pid = table(spark, sf_dir, "conversations"), F.col("conv_id") * 10 + F.col("turn")
    above = F.when(F.col("turn") == 0, -1).when(F.col("turn") % 3 == 2, pid - 2).otherwise(pid - 1)
    rows = c.select(pid.alias("pid"), (F.col("conv_id") + F.col("turn")).alias("birth"), above.alias("parent"), (F.col("conv_id") + 1_000_000_000).alias("group"))
    return op.members(rows, rows.where("pid % 70 = 0").select("pid", "birth"), 1_000_000_003, None)
