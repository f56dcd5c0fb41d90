"""Singular vectors with both sides as tables: products by joins, tall-skinny QR by sums of small squares.

A factor is a table (key, vec) of arrays.  Multiplying by the matrix joins the
entries on one side and adds up on the other.  A tall table is made orthonormal
by its Gram matrix: tasks add up their rows' products, Spark the tasks' sums, and
only n x n numbers come to the driver, whose Cholesky factor is divided out of
all rows; doing that twice leaves an error of rounding only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import CountMatrix
from .store import stored


def _rows(b: pa.RecordBatch, n: int) -> np.ndarray:
    return np.asarray(b.column("vec").flatten()).reshape(-1, n)


def gram(rows: DataFrame, n: int) -> np.ndarray:
    """The sum of all rows' outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = _rows(b, n)
            total += x.T @ x
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((n, n))
    for r in rows.select("vec").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # n x n rows
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def times(rows: DataFrame, key: str, small: np.ndarray) -> DataFrame:
    """Every row times a small square matrix."""
    n = len(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b, n) @ small
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], [key, "vec"])

    return rows.select(key, "vec").mapInArrow(run, f"{key} long, vec array<double>")


def orthonormal(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The same span with orthonormal columns; columns that depend on others become zero."""
    for _ in range(2):
        e, v = np.linalg.eigh(gram(rows, n))
        good = e > max(e.max(initial=0.0), 1e-300) * 1e-15
        rows = stored(times(rows, key, v * np.where(good, 1 / np.sqrt(np.where(good, e, 1.0)), 0.0)))
    return rows


def product(entries: DataFrame, rows: DataFrame, by: str, to: str, n: int, keys: DataFrame) -> DataFrame:
    """(to, vec): for each key the sum over its entries of value times the other side's row."""
    sums = entries.join(rows, by).groupBy(to).agg(*(F.sum(F.col("value") * F.col("vec")[j]).alias(f"s{j}") for j in range(n)))
    return keys.join(sums, to, "left").select(to, F.array(*(F.coalesce(f"s{j}", F.lit(0.0)) for j in range(n))).alias("vec"))


def sums_of(rows: DataFrame, n: int, weight: str | None = None) -> np.ndarray:
    """The (weighted) sum of all rows: n numbers."""
    w = F.col(weight) if weight else F.lit(1.0)
    return np.array([float(v or 0.0) for v in rows.agg(*(F.sum(w * F.col("vec")[j]) for j in range(n))).first()])


def svd_tables(m: CountMatrix, n: int, seed: int = 0, passes: int = 5, centred: bool = False) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores (cell_id, vec), right vectors (gene_id, vec), singular values) by subspace iteration; of cells less their mean if ``centred``."""
    n = max(1, min(n, m.n_genes()))
    entries = stored(m.entries)
    mean = None
    if centred:
        from .prep import gene_mean_var

        mean = stored(gene_mean_var(m).select("gene_id", "mean"))
    noise = F.array(*(F.xxhash64("gene_id", F.lit(seed), F.lit(j)) / F.lit(2.0**63) for j in range(n)))
    q = orthonormal(m.genes.select("gene_id", noise.alias("vec")), "gene_id", n)

    def shifted(rows: DataFrame, shift: np.ndarray) -> DataFrame:
        return rows.withColumn("vec", F.zip_with("vec", F.array(*map(F.lit, map(float, shift))), lambda a, b: a - b)) if centred else rows

    def scores(q: DataFrame) -> DataFrame:
        shift = sums_of(q.join(mean, "gene_id"), n, "mean") if centred else np.zeros(n)
        return stored(shifted(product(entries, q, "gene_id", "cell_id", n, m.cells), shift))

    y = scores(q)
    for _ in range(passes):
        z = product(entries, y, "cell_id", "gene_id", n, m.genes)
        if centred:
            total = sums_of(y, n)
            z = z.join(mean, "gene_id").select("gene_id", F.zip_with("vec", F.array(*map(F.lit, map(float, total))), lambda a, b: a - F.col("mean") * b).alias("vec"))
        q = orthonormal(stored(z), "gene_id", n)
        y = scores(q)
    e, v = np.linalg.eigh(gram(y, n))
    order = np.argsort(-e)
    return stored(times(y, "cell_id", v[:, order])), stored(times(q, "gene_id", v[:, order])), np.sqrt(np.maximum(e[order], 0))
