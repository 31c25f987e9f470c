"""Mixing sources to target weights: token counts per source give repetition rates, and each document
is taken floor(rate) times, plus once more with probability rate - floor(rate), decided by a hash.

The hash of a document's id is turned by the seed of its source, which is one of BUCKETS: that under which
the words of the copies so decided come nearest to what the source wants. A source of few documents, one of
which may hold a fifth of its words, comes as near as its documents allow.

Everything is a DataFrame expression. What is aggregated is at most BUCKETS rows a source; documents are
read twice and joined with one row a source, by broadcast where Spark finds it small and else by a shuffle
whose hot sources adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, free

WORD = r"[^\x20\x09-\x0D]+"
#: Weights in turn for sources in code-point order, the share of all words wanted, the most of a source.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
#: Parts of the hashes' range by which words are counted, and seeds a source has to choose from.
BUCKETS = 256


def words(text: Column) -> Column:
    """The number of runs of bytes other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 by the id; a null id counts as an empty one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / 2.0**48


def _targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """source, source_size, weight, target of rows of source and source_size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    stops = sizes.select("source", "source_size", turn.cast("double").alias("weight")).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = by_stop.rowsBetween
    over_all = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(over_all) * share - F.coalesce(F.sum("stop").over(rows(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rows(0, Window.unboundedFollowing))
    ranked = stops.withColumn("at", F.row_number().over(by_stop)).withColumn("level", level)
    found = F.min_by("level", F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.col("at"))).over(over_all)
    return ranked.withColumn("found", found).select("source", "source_size", "weight", F.least("stop", F.coalesce(F.col("found") * F.col("weight"), F.col("stop"))).alias("target"))


def _turns(tally: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the rate of each source, its fraction, and its turn: where the range of hashes
    that get one copy more begins, in buckets.

    For a range that begins with bucket b and is the fraction of all, the words in its whole buckets and
    in the next, cut one are known; what they may miss of the wanted words at the most is least for the turn
    taken, the first of equals.
    """
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.element_at("by_bucket", b), F.lit(0).cast("long")))
    summed = F.aggregate(F.concat("dense", "dense"), F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    held = tally.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "words"))).alias("by_bucket"))
    held = held.withColumn("dense", dense).withColumn("summed", summed).select(F.col("source").alias("of"), "summed")
    rows = targets.join(held, targets["source"].eqNullSafe(held["of"])).drop("of").withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))
    whole, wanted = F.floor(F.col("fraction") * BUCKETS).cast("int"), F.col("fraction") * F.col("source_size")
    words_of = lambda b, n: F.get("summed", b + n) - F.get("summed", b)
    miss = lambda b: F.greatest(F.abs(words_of(b, whole) - wanted), F.abs(words_of(b, whole + 1) - wanted))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.struct(miss(b).alias("miss"), b.alias("turn"))))
    return rows.select("source", "source_size", "weight", "target", "rate", "fraction", best["turn"].alias("turn"))


def source_targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """source, source_size, weight, target, rate, fraction, turn: one row a source, null as the last of them.

    Targets share ``share`` times all words by weight; one that would pass ``most`` times its
    source's words stops there and the rest is shared anew. With sources in order of most * size /
    weight, the level at which this ends is that of the first source which does not reach its stop.
    A source of no words has target 0. Sources are put in order in one task: a row each.
    """
    bucket = F.floor(_draw(F.col(f"`{id_col}`"), seed) * BUCKETS).alias("bucket")
    tally = Saved(docs.groupBy(F.col(f"`{source_col}`").alias("source"), bucket).agg(F.sum(words(F.col(f"`{text_col}`"))).alias("words")), "sources").df
    targets = _targets(tally.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    return Saved(_turns(tally, targets), "targets").df  # so that its size is known where documents are joined with it


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, rate and copies, in a struct named mix.

    ``copies`` is how often the mix takes the row: the same in every run, since the draw is a hash of
    the seed and the id (a null id counts as an empty one; rows that repeat an id share its draw).
    Rows without words take part with size 0; those of sources without words are taken 0 times. Very long
    texts are counted whole. Columns of ``docs`` may have any names; one named mix is replaced. An
    empty table gives an empty result.
    """
    of, own = free(docs.columns, "of"), free(docs.columns, "own")
    targets = source_targets(docs, id_col, text_col, source_col, weights, share, most, seed).select(F.col("source").alias(of), F.struct("source_size", "target", "rate", "fraction", "turn").alias(f"{of}_to"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "mix"]
    sized = docs.select("*", F.struct(words(F.col(f"`{text_col}`")).alias("size"), _draw(F.col(f"`{id_col}`"), seed).alias("draw")).alias(own))
    mixed = sized.join(targets, F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    to = lambda name: F.col(f"{of}_to.{name}")
    turned = F.col(f"{own}.draw") - to("turn") / F.lit(float(BUCKETS))
    more = F.when(turned < 0, turned + 1.0).otherwise(turned) < to("fraction")
    copies = (F.floor(to("rate")) + more.cast("long")).cast("long")
    return mixed.select(*kept, F.struct(F.col(f"{own}.size").alias("size"), to("source_size").alias("source_size"), to("target").alias("target"), to("rate").alias("rate"), copies.alias("copies")).alias("mix"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns it came with, of any names."""
    own, copy = [F.col(f"`{c}`") for c in mixed.columns if c != "mix"], free(mixed.columns, "copy")
    times = F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))).alias(copy)
    return mixed.where("mix.copies > 0").select(*own, times).drop(copy)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"), "mix.copies")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), stops AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS stop,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sizes
), ranked AS (
  SELECT *, row_number() OVER by_stop AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops WINDOW by_stop AS (ORDER BY stop / weight, source ASC NULLS LAST)
), found AS (
  SELECT min_by(level, place) AS level FROM ranked WHERE stop / weight >= level
), targets AS (
  SELECT ranked.source, source_size, least(stop, coalesce(found.level * weight, stop)) AS target FROM ranked, found
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate FROM targets
), draws AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw FROM sized
), tally AS (
  SELECT source, floor(draw * 256)::INT AS bucket, sum(size)::BIGINT AS words FROM draws GROUP BY ALL
), tried AS (
  SELECT r.source, b.turn, (rate - floor(rate)) * source_size AS wanted, coalesce(sum(words) FILTER ((bucket - turn + 256) % 256 < floor((rate - floor(rate)) * 256)), 0) AS whole,
         coalesce(sum(words) FILTER ((bucket - turn + 256) % 256 <= floor((rate - floor(rate)) * 256)), 0) AS cut
  FROM rates r JOIN tally t ON r.source IS NOT DISTINCT FROM t.source, range(256) AS b(turn) GROUP BY r.source, b.turn, rate, source_size
), turns AS (
  SELECT source, turn FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY greatest(abs(whole - wanted), abs(cut - wanted)), turn) = 1
), taken AS (
  SELECT doc_id, size, source_size, target, (floor(rate) + ((draw - turn / 256.0::DOUBLE + (draw < turn / 256.0::DOUBLE)::INT) < rate - floor(rate))::BIGINT)::BIGINT AS copies
  FROM draws JOIN rates ON draws.source IS NOT DISTINCT FROM rates.source JOIN turns ON draws.source IS NOT DISTINCT FROM turns.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
