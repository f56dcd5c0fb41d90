"""The count matrix: entries, and the complete lists of genes and cells.

Entries hold no zeros.  What depends on zeros (means, medians, variances,
likelihoods) goes through the lists or through a term for an absent entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountMatrix:
    """entries (gene_id, cell_id, value), genes (gene_id), cells (cell_id)."""

    entries: DataFrame
    genes: DataFrame
    cells: DataFrame

    @classmethod
    def of(cls, entries: DataFrame, genes: DataFrame | None = None, cells: DataFrame | None = None) -> CountMatrix:
        """Entries of one place are added up, zeros dropped; lists that aren't given are those of the entries."""
        rows = entries.select(F.col("gene_id").cast("long"), F.col("cell_id").cast("long"), F.col("value").cast("double"))
        rows = rows.groupBy("gene_id", "cell_id").agg(F.sum("value").alias("value")).where("value <> 0")
        genes = rows.select("gene_id").distinct() if genes is None else genes.select(F.col("gene_id").cast("long"))
        cells = rows.select("cell_id").distinct() if cells is None else cells.select(F.col("cell_id").cast("long"))
        return cls(rows, genes, cells)

    @property
    def T(self) -> CountMatrix:
        swapped = self.entries.select(F.col("cell_id").alias("gene_id"), F.col("gene_id").alias("cell_id"), "value")
        return CountMatrix(swapped, self.cells.withColumnRenamed("cell_id", "gene_id"), self.genes.withColumnRenamed("gene_id", "cell_id"))

    def with_values(self, value) -> CountMatrix:
        """Other values at the same places; a function of 0 must be 0."""
        return CountMatrix(self.entries.withColumn("value", value), self.genes, self.cells)

    def without_zeros(self) -> CountMatrix:
        return CountMatrix(self.entries.where("value <> 0"), self.genes, self.cells)

    def select_genes(self, genes: DataFrame) -> CountMatrix:
        """Rows of the listed genes (left-semi)."""
        return CountMatrix(self.entries.join(genes, "gene_id", "left_semi"), self.genes.join(genes, "gene_id", "left_semi"), self.cells)

    def drop_genes(self, genes: DataFrame) -> CountMatrix:
        """The complement (left-anti)."""
        return CountMatrix(self.entries.join(genes, "gene_id", "left_anti"), self.genes.join(genes, "gene_id", "left_anti"), self.cells)

    def select_cells(self, cells: DataFrame) -> CountMatrix:
        return CountMatrix(self.entries.join(cells, "cell_id", "left_semi"), self.genes, self.cells.join(cells, "cell_id", "left_semi"))

    def kept(self) -> CountMatrix:
        """The same with its entries stored, for what reads them more than once."""
        from .store import stored

        return CountMatrix(stored(self.entries), self.genes, self.cells)

    def n_genes(self) -> int:
        return self.genes.count()

    def n_cells(self) -> int:
        return self.cells.count()

    def packed_cells(self) -> DataFrame:
        """One row per cell, empty cells too: (cell_id, idx, val), sorted by gene."""
        rows = self.entries.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("e"))
        rows = self.cells.join(rows, "cell_id", "left")
        empty = F.array().cast("array<bigint>"), F.array().cast("array<double>")
        return rows.select("cell_id", F.coalesce(F.col("e.gene_id"), empty[0]).alias("idx"), F.coalesce(F.col("e.value"), empty[1]).alias("val"))

    def packed_genes(self) -> DataFrame:
        return self.T.packed_cells().withColumnRenamed("cell_id", "gene_id")


def unpacked(packed: DataFrame) -> DataFrame:
    """Entries of packed cells."""
    return packed.select("cell_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(F.col("e.idx").alias("gene_id"), "cell_id", F.col("e.val").alias("value"))


def long_factor(df: DataFrame, key: str, array: str, value: str | None = None) -> DataFrame:
    """(key, k, value) of an array column."""
    return df.select(key, F.posexplode(array).alias("k", value or array))


def packed_factor(df: DataFrame, key: str, value: str, array: str | None = None) -> DataFrame:
    """(key, array) in the order of k."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value))), lambda s: s[value]).alias(array or value))


def components(*factors: DataFrame) -> list[int]:
    """The numbers k of long factors."""
    return sorted({r.k for df in factors for r in df.select("k").distinct().collect()})  # one row per component


def full_factor(df: DataFrame, key: str, value: str, ks: list[int]) -> DataFrame:
    """(key, value) as arrays over the components ``ks``; absent ones are 0."""
    sums = df.groupBy(key).agg(*(F.sum(F.when(F.col("k") == k, F.col(value))).alias(f"v{j}") for j, k in enumerate(ks)))
    return sums.select(key, F.array(*(F.coalesce(f"v{j}", F.lit(0.0)) for j in range(len(ks)))).cast("array<double>").alias(value))


def matrix_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(gene_id, cell_id, value) of long factors (gene_id, k, m) and (cell_id, k, w)."""
    return left.join(right, "k").groupBy("gene_id", "cell_id").agg(F.sum(F.col("m") * F.col("w")).alias("value"))


def reconstruction_at(places: DataFrame, m: DataFrame, w: DataFrame) -> DataFrame:
    """The product at given (gene_id, cell_id) only: arrays m and w are joined to the places, nothing else is made."""
    dot = F.aggregate(F.zip_with("m", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return places.join(m, "gene_id").join(w, "cell_id").withColumn("mw", dot).drop("m", "w")
