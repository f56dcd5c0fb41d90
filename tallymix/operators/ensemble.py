"""Ensembles: several runs, a consensus of their labels, and a warm start from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from .cluster import consensus, poisson_cluster
from .factor import Estimate, _to_one, kmeans_labels, nmf, poisson_estimate_state, truncated_svd
from .matrix import CountMatrix
from .prep import cell_normalize, log1p, log_norm
from .embed import embed_tsne
from .store import stored


def stacked(runs: list[DataFrame]) -> DataFrame:
    """Labels (run, cell_id, cluster) of several clusterings."""
    return reduce(DataFrame.unionByName, (r.select(F.lit(j).alias("run"), "cell_id", "cluster") for j, r in enumerate(runs)))


def poisson_consensus(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    """State estimation from the consensus of Poisson clusterings."""
    m = m.kept()
    runs = stacked([poisson_cluster(m, k, seed=seed + j)[0] for j in range(n_runs)])
    return poisson_estimate_state(m, k, init_weights=stored(consensus(runs, k)), seed=seed, **options)


def poisson_multiclust(m: CountMatrix, k: int, seed: int = 0, **options) -> Estimate:
    """State estimation from the consensus of k-means on {raw, log, norm, log-norm} times {many, k} singular vectors."""
    forms = (m, log1p(m), cell_normalize(m), log_norm(m))
    runs = [kmeans_labels(truncated_svd(f, n, seed)[0], k, seed) for f in forms for n in (min(50, max(1, m.n_genes() - 1)), k)]
    return poisson_estimate_state(m, k, init_weights=stored(consensus(stacked(runs), k)), seed=seed, **options)


def _by_tsne(m: CountMatrix, k: int, estimates: list[Estimate], seed: int) -> DataFrame:
    runs = [kmeans_labels(embed_tsne(e.weights, seed=seed + j).withColumnRenamed("x", "vec"), k, seed) for j, e in enumerate(estimates)]
    return stored(consensus(stacked(runs), k))


def poisson_tsne(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    return poisson_estimate_state(m, k, init_weights=_by_tsne(m, k, [poisson_estimate_state(m, k, seed=seed + j, **options) for j in range(n_runs)], seed), seed=seed, **options)


def nmf_tsne(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    labels = _by_tsne(m, k, [nmf(log_norm(m), k, seed=seed + j) for j in range(n_runs)], seed)
    return nmf_from_labels(log_norm(m), k, labels, **options)


def nmf_from_labels(m: CountMatrix, k: int, labels: DataFrame, **options) -> Estimate:
    from .factor import initial_factors

    means, weights = initial_factors(m, k, labels=labels)
    return nmf(m, k, means.select("gene_id", F.transform("m", lambda v: v + 1e-6).alias("m")), weights, **options)


def state_estimation_ensemble(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    """The stacked means of several runs are estimated once more as a matrix (genes x runs * k); weights are those of the data on its means."""
    runs = [poisson_estimate_state(m, k, seed=seed + j, **options) for j in range(n_runs)]
    columns = reduce(DataFrame.unionByName, (r.means.select("gene_id", F.posexplode("m").alias("c", "value")).select("gene_id", (F.col("c") + j * k).cast("long").alias("cell_id"), "value") for j, r in enumerate(runs)))
    wide = CountMatrix.of(columns.where("value > 1e-12"), m.genes, m.cells.sparkSession.range(n_runs * k).withColumnRenamed("id", "cell_id"))
    second = poisson_estimate_state(wide, k, seed=seed, **options)
    return poisson_estimate_state(m, k, init_means=second.means, seed=seed, **options)


def _weights_of_runs(runs: list[DataFrame], m: CountMatrix, k: int) -> CountMatrix:
    """The runs' weights side by side: runs * k genes, a cell each row's cell."""
    rows = reduce(DataFrame.unionByName, (r.select("cell_id", F.posexplode("w").alias("c", "value")).select((F.col("c") + j * k).cast("long").alias("gene_id"), "cell_id", "value") for j, r in enumerate(runs)))
    return CountMatrix.of(rows, m.cells.sparkSession.range(len(runs) * k).withColumnRenamed("id", "gene_id"), m.cells)


def _restart(m: CountMatrix, k: int, runs: list[DataFrame], seed: int, **options) -> Estimate:
    """The runs' weights are factored, and that factor starts one more run."""
    factor = nmf(_weights_of_runs(runs, m, k), k, seed=seed, normalize_w=False, **options).weights
    return nmf(m, k, init_weights=factor.select("cell_id", F.transform("w", lambda v: v + 1e-9).alias("w")), seed=seed, **options)


def nmf_ensemble(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    """The stacked weights of several runs are factored, and their factor starts one more run."""
    return _restart(m, k, [nmf(m, k, seed=seed + j, **options).weights for j in range(n_runs)], seed, **options)


def nmf_kfold(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, **options) -> Estimate:
    """As ``nmf_ensemble``, each run fitted without one fold of cells (by a hash) whose weights then follow from its means."""
    parts = []
    for j in range(n_runs):
        fold = F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(n_runs)) == j
        fit = nmf(m.select_cells(m.cells.where(~fold)), k, seed=seed + j, **options)
        parts.append(nmf(m, k, init_means=fit.means, max_iters=5, seed=seed + j).weights)
    return _restart(m, k, parts, seed, **options)


def residual_nmf(m: CountMatrix, k: int, ks: int = 1, seed: int = 0, **options) -> Estimate:
    """``k`` rounds of a small NMF, each on what the ones before leave (negative rests as 0)."""
    means, weights, rest, last = None, None, m, None
    side = lambda a, b, key, c: b if a is None else a.withColumnRenamed(c, "before").join(b, key).select(key, F.concat("before", c).alias(c))
    for j in range(k):
        last = nmf(rest, ks, seed=seed + j, normalize_w=False, **options)
        means, weights = stored(side(means, last.means, "gene_id", "m")), stored(side(weights, last.weights, "cell_id", "w"))
        left = last.imputed_at(rest.entries).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - F.col("mw"))).select("gene_id", "cell_id", "value").where("value > 0")
        rest = CountMatrix(stored(left), m.genes, m.cells)
    return Estimate(means, weights.select("cell_id", _to_one("w").alias("w")), last.cost)


def poisson_lda_tsne(m: CountMatrix, k: int, n_runs: int = 10, seed: int = 0, max_iters: int = 50, **options) -> Estimate:
    """State estimation from the consensus of k-means on t-SNE maps of several topic models' weights."""
    from .lda import lda_estimate_state

    labels = _by_tsne(m, k, [lda_estimate_state(m, k, seed=seed + j, max_iters=max_iters) for j in range(n_runs)], seed)
    return poisson_estimate_state(m, k, init_weights=labels, seed=seed, **options)


def labels_of(e: Estimate) -> DataFrame:
    """(cell_id, cluster) by the largest weight."""
    return e.weights.select("cell_id", argmax(F.col("w")).alias("cluster"))
