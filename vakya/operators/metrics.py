"""Relative frequencies, precision and recall, and contingency measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_frequency(pairs: DataFrame, cond: str, value: str) -> DataFrame:
    """cond, value, n and the share of n among the rows of cond."""
    counts = pairs.groupBy(F.col(cond).alias("cond"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cond")))


def precision_recall(counts: DataFrame) -> DataFrame:
    """P, R and F1 of tp, fp, fn: all 1 where nothing is to be found and nothing was, 0 where tp is 0."""
    empty, none = F.expr("tp + fp + fn = 0"), F.col("tp") == 0

    def of(x: Column) -> Column:
        return F.when(empty, 1.0).when(none, 0.0).otherwise(x)

    return counts.select("tp", "fp", "fn", of(F.expr("tp / (tp + fp)")).alias("precision"), of(F.expr("tp / (tp + fn)")).alias("recall"), of(F.expr("2 * tp / (2 * tp + fp + fn)")).alias("f1"))


def v_measure(pairs: DataFrame, cls: str, cluster: str) -> DataFrame:
    """Homogeneity, completeness and V-measure (natural logarithm) of classes against clusters."""
    cell = pairs.groupBy(F.col(cls).alias("c"), F.col(cluster).alias("k")).agg(F.count("*").alias("n"))
    c, k, total = cell.groupBy("c").agg(F.sum("n").alias("nc")), cell.groupBy("k").agg(F.sum("n").alias("nk")), cell.agg(F.sum("n").alias("t"))
    joined = cell.join(c, "c").join(k, "k").crossJoin(F.broadcast(total))
    h = joined.agg(F.coalesce(F.sum(F.expr("-n / t * ln(n / nk)")), F.lit(0.0)).alias("hck"), F.coalesce(F.sum(F.expr("-n / t * ln(n / nc)")), F.lit(0.0)).alias("hkc"),
                   F.coalesce(F.sum(F.expr("-n / t * ln(nc / t)")), F.lit(0.0)).alias("hc"), F.coalesce(F.sum(F.expr("-n / t * ln(nk / t)")), F.lit(0.0)).alias("hk"))
    h = h.select(F.when(F.abs("hc") < 1e-12, 1.0).otherwise(F.expr("1 - hck / hc")).alias("homogeneity"), F.when(F.abs("hk") < 1e-12, 1.0).otherwise(F.expr("1 - hkc / hk")).alias("completeness"))
    return h.withColumn("v_measure", F.expr("if(homogeneity + completeness = 0, 0.0, 2 * homogeneity * completeness / (homogeneity + completeness))"))


def best_mapping(pairs: DataFrame, cls: str, cluster: str) -> DataFrame:
    """many_to_one and one_to_many: shares of rows in the largest cell of their cluster, or of their class."""
    cell = pairs.groupBy(F.col(cls).alias("c"), F.col(cluster).alias("k")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.try_divide(F.sum("m"), F.sum("t")), F.lit(0.0))
    one, many = (cell.groupBy(x).agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg(total.alias(n)) for x, n in (("k", "many_to_one"), ("c", "one_to_many")))
    return one.crossJoin(F.broadcast(many))
