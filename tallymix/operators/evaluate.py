"""Clustering and imputation metrics; each is one aggregate over a contingency table or over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .neighbours import nearest
from .store import stored


def contingency(pred: DataFrame, true: DataFrame, key: str = "cell_id", pred_col: str = "cluster", true_col: str = "label") -> DataFrame:
    """(cluster, label, n)"""
    return pred.join(true, key).groupBy(F.col(pred_col).alias("cluster"), F.col(true_col).alias("label")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    """One row (purity): the share of items in their cluster's most frequent class."""
    tops = table.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return tops.agg((F.sum("top") / F.sum("all")).alias("purity"))


def nmi(table: DataFrame) -> DataFrame:
    """One row (nmi): mutual information over the arithmetic mean of the entropies; 1 if both have one class."""
    total = table.agg(F.sum("n").cast("double").alias("t"))
    cells = table.crossJoin(F.broadcast(total))  # one row
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}"), F.first("t").alias("t"))
    entropy = lambda c: side(c).agg(F.sum(-F.col(f"n_{c}") / F.col("t") * F.log(F.col(f"n_{c}") / F.col("t"))).alias(f"h_{c}"))
    both = cells.join(side("cluster").drop("t"), "cluster").join(side("label").drop("t"), "label")
    mutual = both.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("n_cluster") * F.col("n_label")))).alias("mi"))
    mean = (F.col("h_cluster") + F.col("h_label")) / 2
    return mutual.crossJoin(entropy("cluster")).crossJoin(entropy("label")).select(F.when(mean > 0, F.col("mi") / F.when(mean > 0, mean)).otherwise(1.0).alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    """One row (ari): the adjusted Rand index; 1 if both sides leave no choice."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    side = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")).alias(name))
    sums = table.agg(F.sum(pairs("n")).alias("same"), F.sum("n").cast("double").alias("t")).crossJoin(side("cluster", "a")).crossJoin(side("label", "b"))
    expected = F.col("a") * F.col("b") / pairs("t")
    spread = (F.col("a") + F.col("b")) / 2 - expected
    return sums.select(F.when(spread != 0, (F.col("same") - expected) / F.when(spread != 0, spread)).otherwise(1.0).alias("ari"))


def nearest_label_accuracy(points: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """One row (nne): the share of points whose nearest other point has their label; ties go to the least key."""
    labels = points.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("l"))
    near = nearest(points, 1, key, vec).select("id", "other")
    both = near.join(labels, "id").join(labels.select(F.col("id").alias("other"), F.col("l").alias("lb")), "other")
    return both.agg(F.avg((F.col("l") == F.col("lb")).cast("double")).alias("nne"))


def mean_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds each row's rank by a column, averaged over ties.

    Distinct values are dealt by ranges; a window numbers them within a range,
    and the ranges' totals, one row each, give what lies before.
    """
    values = rows.groupBy(F.col(column).alias("v_")).agg(F.count("*").alias("n_"))
    values = stored(values.repartitionByRange("v_").withColumn("part_", F.spark_partition_id()))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = values.groupBy("part_").agg(F.sum("n_").alias("all_")).withColumn("lower_", before(W.orderBy("part_"), "all_")).select("part_", "lower_")
    ranked = values.join(parts, "part_").withColumn(name, F.col("lower_") + before(W.partitionBy("part_").orderBy("v_"), "n_") + (F.col("n_") + 1) / 2)
    return rows.join(ranked.select("v_", name), F.col(column) == F.col("v_")).drop("v_")


def imputation_error(rows: DataFrame, true: str = "value", guess: str = "mw") -> DataFrame:
    """One row (rmse, relative_rmse, pearson, spearman) of guesses at held-out entries; ranks are averaged over ties."""
    rows = stored(rows.select(F.col(true).alias("true_"), F.col(guess).alias("guess_")))
    ranked = mean_ranks(mean_ranks(rows, "true_", "r_true"), "guess_", "r_guess")
    return ranked.agg(
        F.sqrt(F.avg(F.pow(F.col("true_") - F.col("guess_"), 2))).alias("rmse"),
        F.sqrt(F.avg(F.pow((F.col("true_") - F.col("guess_")) / F.col("true_"), 2))).alias("relative_rmse"),
        F.corr("true_", "guess_").alias("pearson"),
        F.corr("r_true", "r_guess").alias("spearman"),
    )
