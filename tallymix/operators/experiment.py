"""Experiments: preprocessing steps times clusterers times runs, scored into a long table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from .cluster import bicluster, cocluster, consensus, dbscan, poisson_cluster
from .embed import embed_tsne
from .ensemble import stacked
from .evaluate import ari, contingency, nearest_label_accuracy, nmi, purity
from .factor import kmeans_labels, log_norm_nmf, nmf, poisson_estimate_state, truncated_svd
from .lda import lda_estimate_state
from .matrix import CountMatrix, long_factor
from .prep import log1p, log_norm
from .reduce import mds, pca
from .store import stored

Vectors = DataFrame


@dataclass(frozen=True)
class Step:
    """A named preprocessing: a matrix or vectors (cell_id, vec) in, one of both out."""

    name: str
    run: Callable[[CountMatrix | Vectors, int], CountMatrix | Vectors]


@dataclass(frozen=True)
class Clusterer:
    name: str
    run: Callable[[CountMatrix | Vectors, int, int], DataFrame]


def _weights(estimate) -> DataFrame:
    return estimate.weights.withColumnRenamed("w", "vec")


IDENTITY = Step("none", lambda m, k: m)
LOG = Step("log", lambda m, k: log1p(m))
LOG_NORM = Step("log_norm", lambda m, k: log_norm(m))


def svd(n: int) -> Step:
    return Step(f"svd{n}", lambda m, k: truncated_svd(m, n)[0])


def centred_pca(n: int) -> Step:
    return Step(f"pca{n}", lambda m, k: pca(m, n))


def tsne_step(metric: str = "euclidean") -> Step:
    return Step("tsne", lambda v, k: embed_tsne(v.withColumnRenamed("vec", "w"), metric).withColumnRenamed("x", "vec"))


def poisson_step(**options) -> Step:
    return Step("poisson_se", lambda m, k: _weights(poisson_estimate_state(m, k, **options)))


def stored_step(data: CountMatrix | Vectors) -> Step:
    """A step that gives data made before."""
    return Step("stored", lambda m, k: data)


def lda_step(**options) -> Step:
    return Step("lda", lambda m, k: _weights(lda_estimate_state(m, k, **options)))


def ensemble_step(estimate: Callable, **options) -> Step:
    """Any of the ensembles, such as ``poisson_consensus`` or ``nmf_kfold``."""
    return Step(estimate.__name__, lambda m, k: _weights(estimate(m, k, **options)))


def means_step(**options) -> Step:
    """The states themselves as points: (cell_id, vec) is a state's number and its means."""

    def run(m: CountMatrix, k: int) -> Vectors:
        rows = poisson_estimate_state(m, k, **options).means.select("gene_id", F.posexplode("m").alias("cell_id", "v"))
        return rows.groupBy(F.col("cell_id").cast("long").alias("cell_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("gene_id", "v"))), lambda s: s["v"]).alias("vec"))  # k rows

    return Step("poisson_m", run)


def mds_step(dimensions: int = 2, **options) -> Step:
    """Cells by the states' places."""

    def run(m: CountMatrix, k: int) -> Vectors:
        e = poisson_estimate_state(m, k, **options)
        return mds(long_factor(e.means, "gene_id", "m"), e.weights, dimensions).withColumnRenamed("x", "vec")

    return Step("poisson_mds", run)


def imputed_step(**options) -> Step:
    """The matrix as its states reconstruct it at its own entries."""

    def run(m: CountMatrix, k: int) -> CountMatrix:
        e = poisson_estimate_state(m, k, **options)
        return CountMatrix(e.imputed_at(m.entries).select("gene_id", "cell_id", F.col("mw").alias("value")), m.genes, m.cells)

    return Step("imputed", run)


LOG_NMF = Step("log_nmf", lambda m, k: _weights(log_norm_nmf(m, k)))
BASIC_NMF = Step("basic_nmf", lambda m, k: _weights(nmf(m, k)))
ARGMAX = Clusterer("argmax", lambda v, k, seed: v.select("cell_id", argmax(F.col("vec")).alias("cluster")))
KMEANS = Clusterer("km", lambda v, k, seed: kmeans_labels(v, k, seed))
DBSCAN = Clusterer("dbscan", lambda v, k, seed: dbscan(v))
BICLUSTER = Clusterer("bicluster", lambda m, k, seed: bicluster(m, k, seed=seed)[0])
COCLUSTER = Clusterer("cocluster", lambda m, k, seed: cocluster(m, k, seed=seed)[0])
PCA_KMEANS = Clusterer("pca_km", lambda m, k, seed: kmeans_labels(pca(m, min(k, m.n_genes())), k, seed))
TSNE_KMEANS = Clusterer("tsne_km", lambda v, k, seed: kmeans_labels(embed_tsne(v.withColumnRenamed("vec", "w"), seed=seed).withColumnRenamed("x", "vec"), k, seed))
POISSON = Clusterer("poisson", lambda m, k, seed: poisson_cluster(m, k, seed=seed)[0])


def run_experiment(methods: list[tuple[Step | list[Step], Clusterer | list[Clusterer]]], m: CountMatrix, k: int, labels: DataFrame, n_runs: int = 10, use_nmi: bool = True, use_ari: bool = True, use_nne: bool = False, with_consensus: bool = False) -> DataFrame:
    """(run, method, metric, value, seconds) for labels (cell_id, label).

    The output of each chain of steps is stored and shared by its clusterers.
    """
    spark, out, kept = m.cells.sparkSession, [], {}
    for run in range(n_runs):
        for steps, clusterers in methods:
            steps = steps if isinstance(steps, list) else [steps]
            began, data = time.time(), m
            for step in steps:
                data = step.run(data, k)
            if isinstance(data, DataFrame):
                data = stored(data)
            took = time.time() - began
            for clusterer in clusterers if isinstance(clusterers, list) else [clusterers]:
                began, name = time.time(), "_".join([*(s.name for s in steps), clusterer.name])
                found = stored(clusterer.run(data, k, run))
                table = stored(contingency(found, labels))
                scores = {"purity": purity(table).first()[0]}
                if use_nmi:
                    scores["nmi"] = nmi(table).first()[0]
                if use_ari:
                    scores["ari"] = ari(table).first()[0]
                if use_nne and isinstance(data, DataFrame):
                    scores["nne"] = nearest_label_accuracy(data.join(labels, "cell_id"), "cell_id", "vec", "label").first()[0]
                seconds = took + time.time() - began
                out += [(run, name, metric, float(v), seconds) for metric, v in scores.items()]
                kept.setdefault(name, []).append(found)
    if with_consensus:
        for name, runs in kept.items():
            table = contingency(consensus(stacked(runs), k), labels)
            out.append((-1, f"{name}_consensus", "purity", float(purity(table).first()[0]), 0.0))
    return spark.createDataFrame(out, "run int, method string, metric string, value double, seconds double")
