"""Simulators and sampling; every draw is seeded by ids, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import CountMatrix


#: Values that a task holds before it hands them on.
HELD = 1 << 18
#: Bytes of an array of weights that may travel with the tasks' code; more come as a table.
WEIGHT_BYTES = 1 << 26


def _cells(spark: SparkSession, n_cells: int) -> DataFrame:
    return spark.range(n_cells).withColumnRenamed("id", "cell_id")


def _generated(cells: DataFrame, n_genes: int, draw: Callable[..., np.ndarray]) -> CountMatrix:
    """Cells (cell_id, and w where there is one) drawn in their tasks: ``draw(cell, w)`` gives the values of all genes."""
    weighted = "w" in cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            gene, value = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(gene, pa.int64()), pa.array(np.repeat([h[1] for h in held], [len(h[0]) for h in held]), pa.int64()), pa.array(value, pa.float64())], ["gene_id", "cell_id", "value"])

        for b in batches:
            ws = (np.asarray(w, float) for w in b.column("w").to_pylist()) if weighted else iter([None] * b.num_rows)
            for c, w in zip(b.column("cell_id").to_pylist(), ws, strict=True):
                x = np.asarray(draw(c, w), float)
                g = np.flatnonzero(x)
                held.append((g, c, x[g]))
                if len(held) * n_genes >= HELD:
                    yield made()
                    held = []
        if held:
            yield made()

    made = cells.mapInArrow(run, "gene_id long, cell_id long, value double")
    return CountMatrix(made, cells.sparkSession.range(n_genes).withColumnRenamed("id", "gene_id"), cells.select("cell_id"))


def _label(seed: int, c: int, probs: np.ndarray) -> tuple[np.random.Generator, int]:
    rng = np.random.default_rng([seed, c])
    return rng, int(rng.choice(len(probs), p=probs))


def _labels(cells: DataFrame, seed: int, probs: np.ndarray) -> DataFrame:
    """(cell_id, label), each drawn from its cell's own numbers, as its values are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array([_label(seed, c, probs)[1] for c in b.column("cell_id").to_pylist()], pa.int32())], ["cell_id", "label"])

    return cells.select("cell_id").mapInArrow(run, "cell_id long, label int")


def _even(probs, k: int) -> np.ndarray:
    return np.full(k, 1 / k) if probs is None else np.asarray(probs, float)


def poisson_data(spark: SparkSession, centers: np.ndarray, n_cells: int, probs=None, seed: int = 0) -> tuple[CountMatrix, DataFrame]:
    """(matrix, labels (cell_id, label)): a center by probability, then Poisson values."""
    return zip_data(spark, centers, np.zeros_like(np.asarray(centers, float)), n_cells, probs, seed)


def zip_data(spark: SparkSession, centers: np.ndarray, inflation: np.ndarray, n_cells: int, probs=None, seed: int = 0) -> tuple[CountMatrix, DataFrame]:
    """Poisson values, each zeroed by its gene's and cluster's inflation."""
    centers, inflation = np.asarray(centers, float), np.asarray(inflation, float)
    probs, cells = _even(probs, centers.shape[1]), _cells(spark, n_cells)

    def draw(c: int, w: None) -> np.ndarray:
        rng, k = _label(seed, c, probs)
        return rng.poisson(centers[:, k]) * (rng.random(len(centers)) >= inflation[:, k])

    return _generated(cells, len(centers), draw), _labels(cells, seed, probs)


def nb_data(spark: SparkSession, p: np.ndarray, r: np.ndarray, n_cells: int, probs=None, seed: int = 0) -> tuple[CountMatrix, DataFrame]:
    """Negative binomial values by gamma and Poisson: mean r p / (1 - p)."""
    p, r = np.asarray(p, float), np.asarray(r, float)
    probs, cells = _even(probs, p.shape[1]), _cells(spark, n_cells)

    def draw(c: int, w: None) -> np.ndarray:
        rng, k = _label(seed, c, probs)
        return rng.poisson(rng.gamma(r[:, k], p[:, k] / (1 - p[:, k])))

    return _generated(cells, len(p), draw), _labels(cells, seed, probs)


def state_data(spark: SparkSession, means: np.ndarray, weights: np.ndarray | DataFrame, seed: int = 0, inflation: np.ndarray | None = None, r: np.ndarray | None = None) -> CountMatrix:
    """Values around means (genes, k) times weights: Poisson; with ``r`` negative binomial; with ``inflation`` zeroed.

    Weights are a table (cell_id, w), of any size, or an array (k, cells) of at most ``WEIGHT_BYTES``.
    """
    table = isinstance(weights, DataFrame)
    if not table and weights.nbytes > WEIGHT_BYTES:
        raise ValueError(f"weights beyond {WEIGHT_BYTES} bytes: give them as a table (cell_id, w)")
    columns = None if table else weights

    def draw(c: int, w: np.ndarray | None) -> np.ndarray:
        rng = np.random.default_rng([seed, c])
        x = means @ (columns[:, c] if w is None else w)
        y = rng.poisson(x) if r is None else rng.poisson(rng.gamma(np.ravel(r), x / np.ravel(r)))
        return y if inflation is None else y * (rng.random(len(x)) >= inflation)

    return _generated(weights.select("cell_id", "w") if table else _cells(spark, weights.shape[1]), len(means), draw)


def even_weights(cells: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cell_id, w): each cell's weights uniform on the simplex, from hashes of its id."""
    parts = F.array(*(-F.log((F.pmod(F.xxhash64("cell_id", F.lit(seed), F.lit(j)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))) for j in range(k)))
    return cells.select("cell_id", parts.alias("p")).select("cell_id", F.transform("p", lambda v: v / F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("w"))


def lineage_weights(spark: SparkSession, k: int, n_cells_per_state: int) -> DataFrame:
    """(cell_id, w): cells on straight ways from the centre of the simplex to each vertex, made where they are used."""
    cells = _cells(spark, k * n_cells_per_state)
    state, step = F.floor(F.col("cell_id") / n_cells_per_state), F.pmod("cell_id", F.lit(n_cells_per_state))
    own = 1 / k + (1 - 1 / k) * step / max(1, n_cells_per_state - 1)
    other = (1 - own) / (k - 1) if k > 1 else F.lit(0.0)
    return cells.select("cell_id", F.array(*(F.when(state == s, own).otherwise(other) for s in range(k))).alias("w"))


def poisson_states(k: int, n_cells: int, n_genes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(means uniform in 0 .. 100, weights uniform on the simplex)"""
    rng = np.random.default_rng(seed)
    return rng.random((n_genes, k)) * 100, rng.dirichlet(np.ones(k), n_cells).T


def nb_states(k: int, n_cells: int, n_genes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    means, weights = poisson_states(k, n_cells, n_genes, seed)
    return means, weights, np.random.default_rng(seed + 1).integers(1, 100, n_genes).astype(float)


def poisson_lineage(k: int, n_cells_per_state: int, n_genes: int, top: float = 300.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(means, weights): cells on straight ways from the centre of the simplex to each vertex."""
    means = np.random.default_rng(seed).random((n_genes, k)) * top
    step = np.tile(np.arange(n_cells_per_state), k)
    own = 1 / k + (1 - 1 / k) * step / max(1, n_cells_per_state - 1)
    state = np.repeat(np.arange(k), n_cells_per_state)
    weights = np.where(state[None] == np.arange(k)[:, None], own[None], (1 - own[None]) / max(1, k - 1))
    return means, weights


def downsample(m: CountMatrix, share: float, seed: int = 0) -> CountMatrix:
    """Removes a share of all reads: per cell a binomial part of its reads by the share, then a hypergeometric choice among them.

    Given the total this is the multinomial choice over cells and genes, without its global step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, val in zip(b.column("cell_id").to_pylist(), b.column("val").to_pylist(), strict=True):
                rng, x = np.random.default_rng([seed, c & 0x7FFFFFFFFFFFFFFF]), np.rint(np.array(val, float)).astype(np.int64)
                gone = rng.multivariate_hypergeometric(x, rng.binomial(x.sum(), share), method="marginals") if x.sum() else x
                rows.append(np.maximum(x - gone, 0).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), b.column("idx"), pa.array(rows, pa.list_(pa.float64()))], ["cell_id", "idx", "val"])

    from .matrix import unpacked

    packed = m.packed_cells().mapInArrow(run, "cell_id long, idx array<long>, val array<double>")
    return CountMatrix(unpacked(packed).select("gene_id", "cell_id", "value").where("value > 0"), m.genes, m.cells)


def hold_out(m: CountMatrix, share: float, seed: int = 0) -> tuple[CountMatrix, DataFrame]:
    """(matrix without them, held-out entries): entries whose md5 falls into the share."""
    text = F.concat_ws(":", "gene_id", "cell_id", F.lit(seed))
    h = F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(1_000_000)) < int(share * 1_000_000)
    return CountMatrix(m.entries.where(~h), m.genes, m.cells), m.entries.where(h)
