"""Queries on trials and read benchmarks: lineitem stands for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as op
from .register import query, table


@query("""WITH t AS (SELECT l_returnflag || l_linestatus AS mode, CASE WHEN l_returnflag = 'R' AND l_orderkey % 1000 = 1 THEN NULL ELSE l_quantity END AS v FROM lineitem)
SELECT mode, CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.5) END AS median, round(CASE WHEN count(v) = count(*) THEN var_pop(v) END, 6) AS variance,
CASE WHEN count(v) = count(*) THEN min(v) END AS least, CASE WHEN count(v) = count(*) THEN max(v) END AS most, CASE WHEN count(v) = count(*) THEN count(*) END AS trials FROM t GROUP BY mode""")
def trial_summary(spark, sf_dir):
    odd = (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 1000 == 1)
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), F.when(~odd, F.col("l_quantity")).alias("v"))
    return op.trial_summary(rows, "mode", "v").withColumn("variance", F.round("variance", 6))


@query("SELECT l_linestatus AS layout, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def interpolated_percentiles(spark, sf_dir):
    return op.interpolated(table(spark, sf_dir, "lineitem").withColumn("layout", F.col("l_linestatus")), "layout", "l_quantity")


@query("""WITH w AS (SELECT l_linenumber AS workload, l_partkey AS bytes, l_orderkey * 1000 AS ns FROM lineitem)
SELECT workload, count(*) AS operations, sum(bytes)::BIGINT AS bytes, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99,
round((sum(bytes) / 1048576) / (sum(ns) / 1e9::DOUBLE), 9) AS mib_s FROM w GROUP BY workload""")
def read_workloads(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("workload"), F.col("l_partkey").alias("bytes"), (F.col("l_orderkey") * 1000).alias("ns"))
    return op.workload_table(rows, "workload").withColumn("mib_s", F.round("mib_s", 9))


@query("""SELECT l_linenumber AS workload, CASE WHEN sum(l_suppkey) = 0 THEN 0 ELSE sum(l_partkey) / sum(l_suppkey) END AS amplification,
sum(l_partkey) / (sum(l_suppkey) * 2) AS preloaded FROM lineitem GROUP BY 1""")
def read_amplification(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("workload")).agg(F.sum("l_partkey").alias("a"), F.sum("l_suppkey").alias("b"))
    return sums.select("workload", op.amplification(F.col("a"), F.col("b")).alias("amplification"), op.preloaded_amplification(F.col("a"), F.col("b")).alias("preloaded"))


@query("SELECT t.i AS trial, p.i::INT AS place, (['original', 'native', 'store'])[(t.i + p.i) % 3 + 1] AS mode FROM range(12) t(i), range(3) p(i)")
def mode_order(spark, sf_dir):
    return op.rotated(spark.range(12).withColumnRenamed("id", "trial"), ("original", "native", "store"))


@query("SELECT o_orderpriority AS layout, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY 1")
def layout_medians(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("layout")).agg(F.expr("percentile(o_totalprice, 0.5)").alias("median"))


@query("""SELECT n_name, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments, max(c_custkey) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def dimension_counts(spark, sf_dir):
    """A count by a joined dimension."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"), F.max("c_custkey").alias("last"))
