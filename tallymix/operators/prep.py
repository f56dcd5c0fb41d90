"""Totals, moments, normalization and the selection of variable genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matrix import CountMatrix


def cell_totals(m: CountMatrix) -> DataFrame:
    """(cell_id, total) of all cells, empty ones too."""
    sums = m.entries.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return m.cells.join(sums, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def gene_totals(m: CountMatrix) -> DataFrame:
    return cell_totals(m.T).withColumnRenamed("cell_id", "gene_id")


def gene_mean_var(m: CountMatrix) -> DataFrame:
    """(gene_id, mean, var) over all cells, zeros included; the variance is the population's."""
    n = m.cells.agg(F.count("*").cast("double").alias("n"))
    sums = m.entries.groupBy("gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    rows = m.genes.join(sums, "gene_id", "left").fillna(0.0, ["s1", "s2"]).crossJoin(F.broadcast(n))  # one row
    return rows.select("gene_id", F.expr("try_divide(s1, n)").alias("mean"), F.expr("try_divide(s2, n) - try_divide(s1, n) * try_divide(s1, n)").alias("var"))


def max_variance_genes(m: CountMatrix, nbins: int = 5, frac: float = 0.2) -> DataFrame:
    """(gene_id, bin, place): genes sorted by mean in ``nbins`` bins, the last takes the remainder; of each the
    top fraction by variance, if above 0.  Ties go by gene_id.  ``place`` is by bin and then ascending variance.

    The windows go over one row per gene, not over entries.
    """
    stats = gene_mean_var(m)
    n = stats.agg(F.count("*").alias("n_genes"))
    ranked = stats.crossJoin(F.broadcast(n)).withColumn("rn", F.row_number().over(W.orderBy("mean", "gene_id")) - 1)
    size = F.greatest(F.floor(F.col("n_genes") / nbins), F.lit(1))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("rn") / size), F.lit(nbins - 1)).cast("int"))
    top = ranked.withColumn("vr", F.row_number().over(W.partitionBy("bin").orderBy(F.desc("var"), "gene_id"))).where((F.col("vr") <= F.floor(size * frac)) & (F.col("var") > 0))
    return top.select("gene_id", "bin", (F.row_number().over(W.orderBy("bin", F.desc("vr"))) - 1).alias("place"))


def cell_normalize(m: CountMatrix, multiply_means: bool = True) -> CountMatrix:
    """Values over their cell's total, times the median of all cells' totals (if above 0)."""
    totals = cell_totals(m)
    rows = m.entries.join(totals, "cell_id").where("total <> 0")
    if not multiply_means:
        return CountMatrix(rows.select("gene_id", "cell_id", (F.col("value") / F.col("total")).alias("value")), m.genes, m.cells)
    middle = totals.agg(F.median("total").alias("middle"))
    scaled = rows.crossJoin(F.broadcast(middle))  # one row
    scale = F.when(F.col("middle") > 0, F.col("middle")).otherwise(1.0)
    return CountMatrix(scaled.select("gene_id", "cell_id", (F.col("value") / F.col("total") * scale).alias("value")), m.genes, m.cells)


def log1p(m: CountMatrix) -> CountMatrix:
    return m.with_values(F.log1p("value"))


def log_norm(m: CountMatrix) -> CountMatrix:
    return log1p(cell_normalize(m))


def exp10(m: CountMatrix) -> CountMatrix:
    """10^x - 1, which undoes a decimal log of 1 + x."""
    return m.with_values(F.pow(F.lit(10.0), "value") - 1)


def nb_genes(m: CountMatrix, factor: float = 0.9) -> DataFrame:
    """(gene_id, is_nb): whether the variance is well above the mean."""
    return gene_mean_var(m).select("gene_id", (F.col("mean") < factor * F.col("var")).alias("is_nb"))


def bounding_box(cells: DataFrame, array: str = "vec") -> DataFrame:
    """(k, low, high) of each dimension of an array column."""
    return cells.select(F.posexplode(array).alias("k", "v")).groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def value_histogram(m: CountMatrix) -> DataFrame:
    """(gene_id, bin, n): how many cells have each rounded value from 0 to the gene's largest, absent bins as 0."""
    rows = m.entries.groupBy("gene_id", F.round("value").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    n = m.cells.agg(F.count("*").alias("n_cells"))
    tops = m.genes.join(rows.groupBy("gene_id").agg(F.max("bin").alias("top"), F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("nz")), "gene_id", "left").fillna(0, ["top", "nz"]).crossJoin(F.broadcast(n))
    grid = tops.select("gene_id", "nz", "n_cells", F.explode(F.sequence(F.lit(0), F.greatest("top", F.lit(0)))).alias("bin"))
    return grid.join(rows, ["gene_id", "bin"], "left").select("gene_id", "bin", F.when(F.col("bin") == 0, F.col("n_cells") - F.col("nz")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))
