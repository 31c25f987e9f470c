"""Directory trees as tables of nodes, and the process tables that form trees of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, parent
from .numbering import numbered

ROOT_INODE = 1
#: Generations of processes that are found one by one before pointers are doubled.
PLAIN_ROUNDS = 8


def nodes(files: DataFrame) -> DataFrame:
    """Every file and every directory above one: path, name, parent, kind, size. The root is the empty path."""
    directories = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"))
    both = files.select("path", F.lit("file").alias("kind"), F.col("size").cast("long").alias("size")).unionByName(directories)
    return both.withColumn("name", base_name(F.col("path"))).withColumn("parent", parent(F.col("path")))


def inodes(nodes: DataFrame) -> DataFrame:
    """path, inode: the root is 1, the others follow in the order of their paths."""
    return numbered(nodes.select("path"), ["path"], "inode", ROOT_INODE + 1)


def children(nodes: DataFrame) -> DataFrame:
    """parent, path, name of every directory entry; a parent is a directory of the same tree or the root."""
    directories = nodes.where("kind = 'directory'").select(F.col("path").alias("parent")).unionAll(nodes.sparkSession.createDataFrame([("",)], "parent string"))
    return nodes.join(directories, "parent", "left_semi").select("parent", "path", "name", "kind")


def listing(nodes: DataFrame, directory: str) -> DataFrame:
    return nodes.where(F.col("parent") == directory).select("name", "kind", "size")


def page(nodes: DataFrame, cookie: int, most: int) -> DataFrame:
    """Of each directory, the entries behind the first ``cookie``, at most ``most``: parent, place, name."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    return nodes.select("parent", "name", place.cast("long").alias("place")).where((F.col("place") > cookie) & (F.col("place") <= cookie + most))


def totals(nodes: DataFrame) -> DataFrame:
    """One row: files, directories (with the root), logical bytes, blocks of 512 bytes."""
    file = F.col("kind") == "file"
    return nodes.agg(
        F.count_if(file).alias("files"), (F.count_if(~file) + 1).alias("directories"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum(F.expr("(size + 511) div 512")), F.lit(0)).alias("blocks"))


def link_counts(nodes: DataFrame) -> DataFrame:
    """path, nlink of every directory: two and one for each directory in it."""
    inside = nodes.where("kind = 'directory'").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n"))
    return nodes.where("kind = 'directory'").select("path").join(inside, "path", "left").select("path", (F.coalesce("n", F.lit(0)) + 2).alias("nlink"))


def subtree_bytes(nodes: DataFrame) -> DataFrame:
    """path, files, bytes below every directory."""
    below = nodes.where("kind = 'file'").select(F.explode(ancestors(F.col("path"))).alias("path"), "size")
    return below.groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def members(rows: DataFrame, known: DataFrame, group: int | None, root: tuple | None) -> DataFrame:
    """The processes of a session in one snapshot: pid, birth.

    rows: pid, birth, parent, group. known: pid, birth of the members so far. A known process whose pid
    now has another birth is forgotten. Members are those of the group (unless the group's own pid has
    been taken over, that is, is not ``root``), those still known, and all whose parent is a member, to
    any depth: rounds end when one adds nothing. After PLAIN_ROUNDS of them each pid also has a pointer to
    one ancestor, twice as far in each round, so that a chain takes as many more as its length has bits.
    """
    from ..sources.tables import cut

    kept = known.join(rows.select("pid", "birth"), ["pid", "birth"], "left_semi").select("pid", "birth")
    if group is not None:
        leader = rows.where(F.col("pid") == group)
        taken_over = leader.where(~((F.col("pid") == F.lit(root[0])) & (F.col("birth") == F.lit(root[1])))) if root else leader
        free = rows.join(taken_over.select(F.lit(1).alias("t")).limit(1), F.lit(True), "left_anti")
        kept = kept.unionAll(free.where(F.col("group") == group).select("pid", "birth"))
    now, far, done = cut(kept.distinct()), None, 0
    size = now.count()
    while True:
        pids = now.select(F.col("pid").alias("parent"))
        grown = rows.join(pids, "parent", "left_semi").select("pid", "birth")
        if done >= PLAIN_ROUNDS:
            far = cut(_first_pointers(rows) if far is None else _doubled(far))
            below = far.join(pids, "parent", "left_semi").select("pid")
            grown = grown.unionAll(rows.join(below, "pid", "left_semi").select("pid", "birth"))
        now = cut(now.unionAll(grown).distinct())
        before, size, done = size, now.count(), done + 1
        if size == before:
            return now


def _first_pointers(rows: DataFrame) -> DataFrame:
    """pid, parent: one parent, itself a process, of every pid that has any; a pid with several keeps the largest."""
    above = rows.select(F.col("pid").alias("parent"))
    return rows.where("parent <> pid").join(above, "parent", "left_semi").groupBy("pid").agg(F.max("parent").alias("parent"))


def _doubled(far: DataFrame) -> DataFrame:
    """Each pid with the pointer of what it points to; one that points to a pid without a pointer has none."""
    return far.join(far.select(F.col("pid").alias("parent"), F.col("parent").alias("next")), "parent").select("pid", F.col("next").alias("parent"))
