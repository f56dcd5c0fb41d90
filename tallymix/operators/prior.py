"""Qualitative priors (gene_id, k, q) into quantitative starts; a gene whose row is all -1 is missing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import normal_cdf
from .cluster import cluster_means, poisson_assign
from .matrix import CountMatrix
from .store import stored


def missing_genes(q: DataFrame) -> DataFrame:
    return q.groupBy("gene_id").agg(F.max("q").alias("hi"), F.min("q").alias("lo")).where("hi = -1 and lo = -1").select("gene_id")


def binarize(q: DataFrame) -> DataFrame:
    """(gene_id, k, high): whether q is above the middle between the gene's least and largest."""
    ends = q.groupBy("gene_id").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return q.join(ends, "gene_id").select("gene_id", "k", (F.col("q") > F.col("lo") + (F.col("hi") - F.col("lo")) / 2).cast("int").alias("high"))


#: Rows of a table that a task sorts or adds up at a time: larger tables are dealt to more tasks, not to larger ones.
TASK_ROWS = 1 << 18


def tasks_for(df: DataFrame) -> int:
    """Into how many tasks a stored table is dealt."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))


def value_runs(m: CountMatrix, genes: DataFrame) -> DataFrame:
    """(gene_id, value, n): how many cells have each value of a gene, its zeros as one run."""
    tasks, listed = tasks_for(m.entries), m.genes.join(genes, "gene_id", "left_semi")
    runs = stored(m.entries.repartition(tasks, "gene_id", "value").groupBy("gene_id", "value").agg(F.count("*").alias("n")))
    runs = stored(runs.repartition(tasks_for(runs), "gene_id").join(listed, "gene_id", "left_semi"))
    full = listed.join(runs.groupBy("gene_id").agg(F.sum("n").alias("some")), "gene_id", "left")
    zeros = full.select("gene_id", F.lit(0.0).alias("value"), (F.lit(m.n_cells()) - F.coalesce("some", F.lit(0))).alias("n"))
    return runs.unionByName(zeros.where("n > 0"))


def with_prefixes(runs: DataFrame) -> DataFrame:
    """Adds to each run the cells up to it and their sum, and the gene's cells and sum: count, total, n_all, t_all.

    Runs are dealt by ranges of (gene, value), so no gene is gathered: a window
    adds up within a range, and one over a gene's ranges what lies before.
    """
    runs = stored(runs)
    tasks = tasks_for(runs)
    dealt = stored(runs.repartitionByRange(tasks, "gene_id", "value").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("gene_id", "part").agg(F.sum("n").alias("n_part"), F.sum(F.col("value") * F.col("n")).alias("t_part"))
    upto, gene = W.partitionBy("gene_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("gene_id")
    parts = parts.select("gene_id", "part", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("n_part", "t_part")), F.sum("n_part").over(gene).alias("n_all"), F.sum("t_part").over(gene).alias("t_all"))
    own = W.partitionBy("gene_id", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.repartition(tasks, "gene_id", "part").withColumns({"count_": F.sum("n").over(own), "total_": F.sum(F.col("value") * F.col("n")).over(own)})
    return summed.join(stored(parts), ["gene_id", "part"]).select("gene_id", "value", "n", (F.col("count_") + F.col("n_part_before")).alias("count"), (F.col("total_") + F.col("t_part_before")).alias("total"), "n_all", "t_all")


def gene_levels(m: CountMatrix, genes: DataFrame, gaussian: bool = False) -> DataFrame:
    """(gene_id, low, high, w2): the levels of a gene's two groups over all cells, zeros included, and the Poisson test between them.

    In one dimension the optimum of Poisson (or squared-error) 2-means is a cut
    of the sorted values, so all cuts are tried by prefix sums and the first of
    the best (to 9 places) is taken.  Levels are the groups' medians, or their
    means if ``gaussian``; a gene of one value has it for both.
    """
    return _levels(m.kept(), genes, gaussian)


def _levels(m: CountMatrix, genes: DataFrame, gaussian: bool) -> DataFrame:
    """``gene_levels`` of a matrix whose entries are stored."""
    left, right = F.col("total") / F.col("count"), (F.col("t_all") - F.col("total")) / (F.col("n_all") - F.col("count"))
    rest = F.col("t_all") - F.col("total")
    gain = F.col("total") * left + rest * right if gaussian else F.col("total") * F.log(left + 1e-10) + rest * F.log(right + 1e-10)
    rows = stored(with_prefixes(value_runs(m, genes)).withColumn("gain", F.when(F.col("count") < F.col("n_all"), F.round(gain, 9))))
    best = stored(rows.where("count < n_all").groupBy("gene_id").agg(F.max("gain").alias("best")))
    rows = rows.repartition(tasks_for(rows), "gene_id")
    # an order by (gain, count) in one aggregate would sort all rows
    cuts = rows.where("count < n_all").join(best, "gene_id").where("gain <=> best").groupBy("gene_id").agg(F.min("count").alias("cut"))
    both = rows.join(cuts, "gene_id", "left")
    low = F.col("count") <= F.coalesce("cut", "n_all")
    # a run's cells have the places count - n + 1 to count
    at = lambda place: F.min(F.when(F.col("count") >= place, F.col("value")))
    middle = lambda first, last: (at(F.floor((first + last) / 2)) + at(F.ceil((first + last) / 2))) / 2
    one, cut, last = F.lit(1), F.coalesce("cut", "n_all"), F.col("n_all")
    start = F.when(F.col("cut").isNull(), one).otherwise(F.col("cut") + 1)
    out = both.groupBy("gene_id").agg(
        middle(one, cut).alias("low"), middle(start, last).alias("high"),
        F.sum(F.when(low, F.col("value") * F.col("n"))).alias("a"), F.sum(F.when(~low, F.col("value") * F.col("n"))).alias("c"),
        F.sum(F.when(low, F.col("n"))).alias("ka"), F.sum(F.when(~low, F.col("n"))).alias("kc"),
    )
    a, c, ratio = F.col("a") + 1e-5 * F.col("ka"), F.col("c") + 1e-5 * F.col("kc"), F.col("kc") / F.col("ka")
    w2 = F.coalesce((c - a * ratio) / F.sqrt((a + c) * ratio), F.lit(0.0))
    if gaussian:
        return out.select("gene_id", (F.col("a") / F.col("ka")).alias("low"), F.coalesce(F.col("c") / F.col("kc"), F.col("a") / F.col("ka")).alias("high"), w2.alias("w2"))
    return out.select("gene_id", "low", "high", w2.alias("w2"))


def output_from_levels(q: DataFrame, levels: DataFrame, eps: float = 0.0, from_least: bool = True) -> DataFrame:
    """(gene_id, k, m): the gene's high level where the prior says high, else its low one.

    High is above the middle between the gene's least and largest q; without
    ``from_least``, above half of what lies between them.
    """
    ends = q.groupBy("gene_id").agg(F.min("q").alias("lo_"), F.max("q").alias("hi_"))
    limit = (F.col("hi_") - F.col("lo_")) / 2 + (F.col("lo_") if from_least else F.lit(0.0))
    rows = q.join(ends, "gene_id").join(levels, "gene_id")
    return rows.select("gene_id", "k", F.when(F.col("q") > limit, F.col("high")).otherwise(F.col("low") + eps).alias("m"))


def nearest_centers(m: CountMatrix, means: DataFrame) -> DataFrame:
    """(cell_id, cluster) by squared distance to centers (gene_id, k, m), to 9 places; ties to the least k."""
    base = means.groupBy("k").agg(F.sum(F.col("m") * F.col("m")).alias("base"))
    dots = m.entries.join(means, "gene_id").groupBy("cell_id", "k").agg(F.sum(F.col("value") * F.col("m")).alias("dot"))
    rows = m.cells.crossJoin(F.broadcast(base)).join(dots, ["cell_id", "k"], "left")  # one row per center
    d = F.round(F.col("base") - 2 * F.coalesce("dot", F.lit(0.0)), 9)
    return rows.groupBy("cell_id").agg(F.min_by("k", F.struct(d, "k")).cast("int").alias("cluster"))


def qual_norm(m: CountMatrix, q: DataFrame, gaussian: bool = False) -> DataFrame:
    """(gene_id, k, m) for all genes of the prior; missing genes get the means of one assignment by the known ones, or
    the gene's mean where a cluster stays empty."""
    m, missing = m.kept(), stored(missing_genes(q))
    known = q.join(missing, "gene_id", "left_anti")
    out = stored(output_from_levels(known, _levels(m, known.select("gene_id").distinct(), gaussian), from_least=not gaussian))
    if missing.isEmpty():
        return out
    # what follows joins entries by gene, in as many tasks as they need
    m = CountMatrix(m.entries.repartition(tasks_for(m.entries), "gene_id"), m.genes, m.cells)
    k = q.agg(F.max("k")).first()[0] + 1
    labels = stored((nearest_centers if gaussian else poisson_assign)(m.select_genes(known.select("gene_id").distinct()), out))
    sizes = labels.groupBy(F.col("cluster").alias("k")).count()
    rest = m.select_genes(missing)
    n = m.n_cells()
    mean = rest.genes.join(rest.entries.groupBy("gene_id").agg((F.sum("value") / n).alias("mean")), "gene_id", "left").fillna(0.0)
    means = cluster_means(rest, labels, k).join(sizes, "k", "left").join(mean, "gene_id")
    return out.unionByName(means.select("gene_id", "k", F.when(F.col("count").isNull(), F.col("mean")).otherwise(F.col("m")).alias("m")))


def qual_norm_gaussian(m: CountMatrix, q: DataFrame) -> DataFrame:
    """The same by squared error: levels are means, cells go to the nearest center, and high is above half the prior's range."""
    return qual_norm(m, q, gaussian=True)


def qual_norm_filter_genes(m: CountMatrix, q: DataFrame, pval_threshold: float = 0.05, eps: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(means (gene_id, k, m) of the genes kept, p-values (gene_id, p)): genes whose two groups differ by the Poisson test."""
    known = q.join(missing_genes(q), "gene_id", "left_anti")
    levels = stored(gene_levels(m, known.select("gene_id").distinct()).withColumn("p", 1 - normal_cdf(F.col("w2"))))
    kept = levels.where(F.col("p") <= pval_threshold)
    return output_from_levels(known.join(kept, "gene_id", "left_semi"), kept, eps), levels.select("gene_id", "p")


def mean_normalized_prior(q: DataFrame, mean_total: float) -> DataFrame:
    """(gene_id, k, m): each type's values scaled to sum to the mean library size."""
    sums = q.groupBy("k").agg(F.sum("q").alias("s"))
    return q.join(sums, "k").select("gene_id", "k", (F.coalesce(F.expr("try_divide(q, s)"), F.lit(0.0)) * mean_total).alias("m"))
