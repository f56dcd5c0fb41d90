"""The queries over the driver's tables and the SQL that checks them.

The count matrix is parts by suppliers, whole.  Queries that SQL checks use fixed
factors: means 1 + (7 g + 3 k) mod 11 and weights 0.75 for the component c mod
3, else 0.125; iterative ones make one or two rounds from there.  Queries
without SQL draw their starts and run on the same matrix.  Real results are
rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import special, vectors
from ..operators import cluster, density, dispersed, embed, ensemble, evaluate, experiment, factor, fitdist, lda, likelihood, lineage, matrix, neighbours, prep, prior, reduce, simulate
from ..operators.store import shared_folder, stored
from ..sources import tables, text

K = 3


def _x(spark: SparkSession, d: str) -> matrix.CountMatrix:
    return tables.part_supplier(spark, d)


def _ks() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(K - 1)))


def _means(m: matrix.CountMatrix) -> DataFrame:
    return m.genes.select("gene_id", _ks().alias("k")).withColumn("m", (1 + F.pmod(F.col("gene_id") * 7 + F.col("k") * 3, F.lit(11))).cast("double"))


def _weights(m: matrix.CountMatrix) -> DataFrame:
    return m.cells.select("cell_id", _ks().alias("k")).withColumn("w", F.when(F.pmod("cell_id", F.lit(3)) == F.col("k"), 0.75).otherwise(0.125))


def _labels(m: matrix.CountMatrix) -> DataFrame:
    return m.cells.select("cell_id", F.pmod("cell_id", F.lit(3)).cast("int").alias("cluster"))


def _true(m: matrix.CountMatrix) -> DataFrame:
    return m.cells.select("cell_id", F.pmod(F.floor(F.col("cell_id") / 4), F.lit(5)).cast("int").alias("label"))


def _am(m):
    return matrix.packed_factor(_means(m), "gene_id", "m")


def _aw(m):
    return matrix.packed_factor(_weights(m), "cell_id", "w")


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Rounded, without a negative zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in names})


def _entries(m: matrix.CountMatrix) -> DataFrame:
    return _r(m.entries, "value")


def _w_long(df: DataFrame, key: str = "cell_id", value: str = "w") -> DataFrame:
    return _r(df.select(key, F.posexplode(value).alias("k", "value")), "value")


def _small_genes(spark, d) -> DataFrame:
    return tables.table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("gene_id"))


def _points(spark, d) -> DataFrame:
    """Embeddings' first two dimensions as places, labels as clusters."""
    return tables.embedding_points(spark, d).select("cell_id", F.col("label").cast("int").alias("cluster"), F.round(F.get("vec", F.lit(0)), 6).alias("fx"), F.round(F.get("vec", F.lit(1)), 6).alias("fy"))


def _places(spark, d) -> DataFrame:
    """Embeddings' first two dimensions with their labels."""
    return tables.embedding_points(spark, d).select("cell_id", F.slice("vec", 1, 2).alias("vec"), "label")


def _prior(m: matrix.CountMatrix) -> DataFrame:
    """A qualitative prior of four types; genes that divide by 17 are missing."""
    rows = m.genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.withColumn("q", F.when(F.pmod("gene_id", F.lit(17)) == 0, -1.0).otherwise(F.pmod(F.col("gene_id") * 5 + F.col("k") * 7, F.lit(9)).cast("double")))


def _sweep_m(m: matrix.CountMatrix) -> DataFrame:
    weights = _am(m).select(F.col("gene_id").alias("cell_id"), F.col("m").alias("w"))
    means = _aw(m).select(F.col("cell_id").alias("gene_id"), F.col("w").alias("m"))
    return factor.sweep(m.T, means, weights, K).withColumnRenamed("cell_id", "gene_id")


def _pair_distance(fn) -> Callable[[SparkSession, str], DataFrame]:
    """Each cell's weights against the mixture that its successor would have."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = _x(spark, d)
        other = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda j: F.when(F.pmod(F.col("cell_id") + 1, F.lit(3)) == j, F.lit(0.5)).otherwise(F.lit(0.25)))
        return _r(_aw(m).select("cell_id", fn(F.col("w"), other).alias("value")), "value")

    return run


def _imputed(m: matrix.CountMatrix) -> DataFrame:
    return matrix.reconstruction_at(m.entries, _am(m), _aw(m))


def _one(df: DataFrame, *names: str) -> DataFrame:
    return _r(df, *(names or df.columns))


def _fit_errors(spark: SparkSession, d: str) -> DataFrame:
    return _r(fitdist.fit_errors(_x(spark, d)), "poiss", "norm", "lognorm")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State estimation of suppliers by ordered parts: each supplier's weights and its largest component."""
    e = factor.poisson_estimate_state(_x(spark, sf_dir), K, max_iters=5, inner_max_iters=30, initialization="random")
    return e.weights.select("cell_id", vectors.argmax(F.col("w")).alias("cluster"), "w").orderBy("cell_id")


def flagship_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the default of 30 times 100 sweeps."""
    return factor.poisson_estimate_state(_x(spark, sf_dir), K, initialization="random").weights


def _fixed(m: matrix.CountMatrix) -> factor.Estimate:
    return factor.Estimate(_am(m), _aw(m), 0.0)


def _spread(m: matrix.CountMatrix) -> DataFrame:
    """Weights (cell_id, w): the shares that the genes 0, 1 and 2 mod 3 have in a cell's counts, each with one count more."""
    sums = m.entries.groupBy("cell_id").agg(*(F.sum(F.when(F.pmod("gene_id", F.lit(K)) == j, F.col("value"))).alias(f"s{j}") for j in range(K)))
    raw = m.cells.join(sums, "cell_id", "left").select("cell_id", F.array(*(F.coalesce(f"s{j}", F.lit(0.0)) + 1 for j in range(K))).alias("w"))
    return raw.select("cell_id", vectors.normalized(F.col("w")).alias("w"))


def _thousandths(df: DataFrame) -> DataFrame:
    """Places in the hundreds, whose closed form in SQL keeps fewer digits than the eigenvectors."""
    return df.withColumn("value", F.round("value", 3) + 0.0)


def _state_means(m: matrix.CountMatrix) -> DataFrame:
    """The means of the fixed labels' clusters."""
    return cluster.cluster_means(m, _labels(m), K)


def _two(m: matrix.CountMatrix, **options) -> factor.Estimate:
    """Two rounds of one sweep each from the fixed labels."""
    return factor.run_state_estimation(m, K, init_weights=_labels(m), max_iters=2, inner_max_iters=1, **options)


def _nb_params(m: matrix.CountMatrix) -> DataFrame:
    return _means(m).select("gene_id", "k", F.lit(0.3).alias("p"), F.col("m").alias("r"))


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select("cell_id", F.col("cluster").cast("int").alias("cluster"))


def _params(df: DataFrame, *names: str) -> DataFrame:
    return _r(df.select("gene_id", "k", *names), *names)


def _experiment(spark: SparkSession, m: matrix.CountMatrix) -> DataFrame:
    one = experiment.Clusterer("em", lambda x, k, seed: cluster.em_step(x, _labels(x), k))
    return _r(experiment.run_experiment([(experiment.IDENTITY, one)], m, K, _true(m), n_runs=1).select("run", "method", "metric", "value"), "value")


def _chains(spark: SparkSession, m: matrix.CountMatrix) -> DataFrame:
    """Five chains of a step and a clusterer from fixed starts, scored against one set of labels."""
    make, m = experiment.Clusterer, m.kept()
    hard = [
        make("em", lambda x, k, seed: cluster.em_step(x, _labels(x), k)),
        make("em2", lambda x, k, seed: cluster.em_step(x, stored(cluster.em_step(x, _labels(x), k)), k)),
        make("zip", lambda x, k, seed: cluster.zip_cluster(x, k, 2, init=_labels(x))[0]),
        make("nb", lambda x, k, seed: cluster.nb_cluster(x, k, 2, init=_labels(x))[0]),
    ]
    states = experiment.Step("states", lambda x, k: _two(x).weights.withColumnRenamed("w", "vec"))
    return _r(experiment.run_experiment([(experiment.IDENTITY, hard), (states, experiment.ARGMAX)], m, K, _true(m), n_runs=1).select("run", "method", "metric", "value"), "value")


def _written(lines: DataFrame) -> str:
    path = shared_folder(lines.sparkSession)
    text.write_lines(lines, path)
    return path


def _by_line(df: DataFrame, m: matrix.CountMatrix) -> DataFrame:
    """Line numbers as the cells that were written in order of their ids."""
    ranks = m.cells.select(F.col("cell_id").alias("cell"), (F.row_number().over(W.orderBy("cell_id")) - 1).alias("cell_id"))  # one row per cell
    return df.join(ranks, "cell_id").drop("cell_id").withColumnRenamed("cell", "cell_id")


def _matrix_market(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    text.write_matrix_market(_x(spark, d), path)
    return _entries(text.read_matrix_market(spark, path))


def _dense_text(spark: SparkSession, d: str) -> DataFrame:
    """The first eight parts' values of each supplier, written as a white-space matrix and read again."""
    m = _x(spark, d)
    rows = m.cells.join(m.entries.where("gene_id between 1 and 8"), "cell_id", "left").groupBy("cell_id").pivot("gene_id", list(range(1, 9))).agg(F.first("value"))
    lines = rows.select("cell_id", F.concat_ws(" ", *(F.coalesce(F.col(str(g)), F.lit(0.0)).cast("string") for g in range(1, 9))).alias("line"))
    back = text.read_dense(spark, _written(lines)).T.entries
    return _r(_by_line(back, m).select((F.col("gene_id") + 1).alias("gene_id"), "cell_id", "value"), "value")


def _noisy_runs(m: matrix.CountMatrix, n: int = 5) -> DataFrame:
    """Clusterings that name the clusters of one EM step differently, each wrong for another seventh of the cells."""
    base = stored(cluster.em_step(m, _labels(m), K))
    runs = base.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("run"), "cell_id", "cluster")
    wrong = (F.pmod(F.col("cell_id") + 2 * F.col("run"), F.lit(7)) == 0).cast("int")
    return runs.select("run", "cell_id", F.pmod(F.col("cluster") + F.col("run") + wrong, F.lit(K)).cast("int").alias("cluster"))


def _lda_tokens(spark: SparkSession, m: matrix.CountMatrix) -> DataFrame:
    """Tokens of each gene and each cell after three passes: sampling moves them between topics only."""
    state = stored(lda.sampled(m, K, 0.05, 0.01, 3, 2))
    both = [lda.topic_counts(state, key, K).select(F.lit(side).alias("side"), F.col(key).alias("id"), F.aggregate("nw", F.lit(0).cast("long"), lambda s, v: s + v).alias("tokens")) for side, key in (("gene", "gene_id"), ("cell", "cell_id"))]
    return both[0].unionByName(both[1])


def _certain(m: matrix.CountMatrix) -> DataFrame:
    """Weights that put a cell wholly into the component c mod 3."""
    return m.cells.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda j: (F.pmod("cell_id", F.lit(3)) == j).cast("double")).alias("w"))


def _landmarks(m: matrix.CountMatrix, n: int) -> DataFrame:
    return m.cells.orderBy("cell_id").limit(n)


def _iterative() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Iterative operators on the whole matrix."""

    def on(fn):
        return lambda s, d: fn(s, _x(s, d))

    return {
        # one or two rounds from a fixed start, for SQL
        "kmeans_pp": on(lambda s, m: _labelled(cluster.kmeans_pp(m, K, seed=1)[1])),
        "poisson_cluster": on(lambda s, m: _labelled(cluster.poisson_cluster(m, K, _means(m), 2)[0])),
        "zip_cluster": on(lambda s, m: _labelled(cluster.zip_cluster(m, K, 2, init=_labels(m))[0])),
        "zip_cluster_params": on(lambda s, m: _params(cluster.zip_cluster(m, K, 1, init=_labels(m))[1], "m", "z")),
        "nb_cluster": on(lambda s, m: _labelled(cluster.nb_cluster(m, K, 2, init=_labels(m))[0])),
        "run_state_estimation": on(lambda s, m: _w_long(_two(m).weights)),
        "state_means": on(lambda s, m: _w_long(_two(m).means, "gene_id", "m")),
        "zip_state_estimation": on(lambda s, m: _w_long(_two(m, dist="zip").weights)),
        "nb_state_estimation": on(lambda s, m: _w_long(dispersed.nb_estimate_state(m, K, m.genes.select("gene_id", (1.0 + F.pmod("gene_id", F.lit(5))).alias("r")), init_weights=_labels(m))[0].weights)),
        "norm_nmf": on(lambda s, m: _w_long(factor.norm_nmf(m, K, init_means=_am(m), init_weights=_aw(m), max_iters=1, inner=2).weights)),
        "log_norm_nmf": on(lambda s, m: _w_long(factor.log_norm_nmf(m, K, init_means=_am(m), init_weights=_aw(m), max_iters=1, inner=2).weights)),
        "update_m": on(lambda s, m: _w_long(factor.update_m(m, _fixed(m), 1).means, "gene_id", "m")),
        "mds": on(lambda s, m: _thousandths(_w_long(reduce.mds(_state_means(m), _spread(m)), value="x"))),
        "diffusion_mds": on(lambda s, m: _thousandths(_w_long(reduce.diffusion_mds(_state_means(m), _spread(m), rounds=2), value="x"))),
        "zip_fit": on(lambda s, m: _r(dispersed.zip_fit(m), "lam", "pi")),
        "dist_fit_best": lambda s, d: fitdist.best_distribution(_x(s, d)),
        "qual_norm_levels": on(lambda s, m: _r(prior.gene_levels(m, m.genes), "low", "high", "w2")),
        "qual_norm_filter_genes": on(lambda s, m: _r(prior.qual_norm_filter_genes(m, _prior(m))[0], "m")),
        "hold_out": on(lambda s, m: _r(simulate.hold_out(m, 0.1)[1].select("gene_id", "cell_id", "value"), "value")),
        "dbscan": lambda s, d: density.dbscan(_points(s, d).select("cell_id", F.array("fx", "fy").alias("vec")), 0.05, 5),
        "run_experiment": on(_experiment),
        "run_experiment_chains": on(_chains),
        "nearest_weights": on(lambda s, m: _w_long(factor.nearest_weights(m, _means(m), K))),
        "nmf_start": on(lambda s, m: _w_long(factor.nmf_start(m, _labels(m), K)[1])),
        "nb_objective": on(lambda s, m: _one(dispersed.nb_objective(m, _means(m), _weights(m), m.genes.select("gene_id", (1.0 + F.pmod("gene_id", F.lit(5))).alias("r"))))),
        "zip_objective": on(lambda s, m: _one(dispersed.zip_objective(m, _means(m), _weights(m), m.genes.select("gene_id", (F.pmod("gene_id", F.lit(5)) / 10.0).alias("z"))))),
        "zinb_ll": on(lambda s, m: _r(likelihood.zinb_ll(m, _nb_params(m).withColumn("z", F.col("k") * 0.2)), "ll")),
        # drawn starts, run to their end
        "poisson_state_estimation": flagship,
        "run_baseline": on(lambda s, m: factor.run_baseline(m, K).weights),
        "lbfgs_state_estimation": on(lambda s, m: factor.poisson_estimate_state(m, K, max_iters=2, inner_max_iters=20, initialization="random", method="L-BFGS-B").weights),
        "lda_state_estimation": on(lambda s, m: lda.lda_estimate_state(m, K, max_iters=10).weights),
        "lda_tokens": on(_lda_tokens),
        "lda_warm_start": on(lambda s, m: _w_long(lda.lda_estimate_state(m, K, max_iters=0, init_means=_am(m), init_weights=_certain(m)).weights)),
        "gap_statistic": on(lambda s, m: s.createDataFrame([(k, *cluster.gap(cluster.reduced(m), k, 2)) for k in (1, 3)], "k int, gap double, s double")),
        "select_k": on(lambda s, m: s.createDataFrame([(cluster.select_k(m),)], "k int")),
        "truncated_svd": on(lambda s, m: factor.truncated_svd(prep.log_norm(m), 3)[0]),
        "pca": on(lambda s, m: reduce.pca(prep.log_norm(m), 2)),
        "tsne": on(lambda s, m: embed.embed_tsne(_two(m).weights)),
        "landmark_distances": on(lambda s, m: _r(reduce.landmark_distances(m, _landmarks(m, 16)), "d")),
        "landmark_axis": on(lambda s, m: _w_long(reduce.dim_reduce_data(m, 1, _landmarks(m, 2)), value="x")),
        "dim_reduce_data": on(lambda s, m: reduce.dim_reduce_data(m, 2)),
        "diffusion_impute": on(lambda s, m: reduce.diffusion_impute(m, 3, 2, 10, 5)),
        "run_lineage": on(lambda s, m: lineage.run_lineage(_state_means(m), _spread(m))[1]),
        "nb_fit": lambda s, d: _r(dispersed.nb_fit(_x(s, d)).select("gene_id", "p", F.log("r").alias("log_r")), "p", "log_r"),
        "qual_norm": lambda s, d: _r(prior.qual_norm(_x(s, d), _prior(_x(s, d))), "m"),
        "qual_norm_gaussian": lambda s, d: _r(prior.qual_norm_gaussian(_x(s, d), _prior(_x(s, d))), "m"),
        "simulate_poisson": on(lambda s, m: simulate.poisson_data(s, np.array([[2, 14, 31], [3, 17, 2], [60, 4, 90], [7, 25, 5]], float), m.n_cells(), seed=7)[0].entries),
        "nmf_kfold": on(lambda s, m: _w_long(ensemble.nmf_kfold(m, K, 2, max_iters=5).weights)),
        "simulate_states": on(lambda s, m: simulate.state_data(s, simulate.poisson_states(K, 1, 50)[0], _two(m).weights).entries),
        "simulate_zip_states": on(lambda s, m: simulate.state_data(s, simulate.poisson_states(K, 1, 50)[0], simulate.even_weights(m.cells, K), inflation=np.full(50, 0.3)).entries),
        "simulate_nb_states": on(lambda s, m: simulate.state_data(s, simulate.poisson_states(K, 1, 50)[0], simulate.even_weights(m.cells, K), r=np.full(50, 4.0)).entries),
        "simulate_lineage": on(lambda s, m: simulate.state_data(s, simulate.poisson_states(K, 1, 20)[0] * 3, simulate.lineage_weights(s, K, m.n_cells() // K)).entries),
        "downsample": on(lambda s, m: simulate.downsample(m, 0.1).entries),
        "bicluster": on(lambda s, m: cluster.bicluster(m, K, 2)[0]),
        "cocluster": on(lambda s, m: cluster.cocluster(m, K)[0]),
        "consensus": on(lambda s, m: cluster.consensus(_noisy_runs(m), K)),
        "cluster_overlaps": on(lambda s, m: cluster.cluster_overlaps(_noisy_runs(m))),
        "poisson_consensus": on(lambda s, m: ensemble.poisson_consensus(m, K, 2, max_iters=1, inner_max_iters=10).weights),
        "nmf_ensemble": on(lambda s, m: _w_long(ensemble.nmf_ensemble(m, K, 2, max_iters=10).weights)),
        "residual_nmf": on(lambda s, m: _w_long(ensemble.residual_nmf(m, K, max_iters=15).weights)),
    }


def _columns() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Sources, sinks and small transformations."""
    m = lambda fn: lambda s, d: fn(_x(s, d))
    return {
        "read_matrix_market": _matrix_market,
        "read_dense": _dense_text,
        "read_word_counts": m(lambda x: _r(_by_line(text.read_word_counts(x.cells.sparkSession, _written(text.word_lines(x))), x).select("gene_id", "cell_id", "value"), "value")),
        "word_lines_dense": m(lambda x: text.word_lines(x.select_genes(x.genes.where("gene_id <= 20")), include_zeros=True)),
        "model_lines": m(lambda x: text.model_lines(_am(x).withColumn("m", F.transform("m", lambda v: v - 3)), "gene_id", "m").withColumnRenamed("cell_id", "gene_id")),
        "dictionary_lines": m(lambda x: text.dictionary_lines(x.cells.sparkSession, x.n_genes()).withColumnRenamed("cell_id", "gene_id")),
        "read_topic_lines": m(lambda x: _r(text.read_topic_lines(x.cells.sparkSession, _written(text.model_lines(_am(x), "gene_id", "m"))), "value")),
        "read_word_topics": m(lambda x: _r(text.read_word_topics(x.cells.sparkSession, _written(_am(x).select(F.col("gene_id").alias("cell_id"), F.concat(F.lit("G"), F.col("gene_id").cast("string"), F.lit(" "), F.array_join(F.col("m").cast("array<string>"), " ")).alias("line")))), "value")),
        "read_document_topics": m(lambda x: _r(_by_line(text.read_document_topics(x.cells.sparkSession, _written(_aw(x).select("cell_id", F.array_join(F.col("w").cast("array<string>"), " ").alias("line")))), x).select("cell_id", "k", "value"), "value")),
        "cell_subset": m(lambda x: _entries(x.select_cells(x.cells.where("cell_id % 3 = 1")))),
        "exp10": m(lambda x: _r(prep.exp10(x.with_values(F.col("value") / 100)).entries, "value")),
        "relu": m(lambda x: _entries(x.with_values(vectors.relu(F.col("value") - 25)).without_zeros())),
        "packed_round_trip": m(lambda x: _r(matrix.unpacked(x.packed_cells()).select("gene_id", "cell_id", "value"), "value")),
        "distinct_labels": m(lambda x: _true(x).select("label").distinct()),
        "nb_genes_of_all_clusters": m(lambda x: reduce_and([prep.nb_genes(x.select_cells(_labels(x).where(F.col("cluster") == j).select("cell_id"))) for j in range(K)])),
        "zip_row_ll": m(lambda x: _r(likelihood.zip_ll(x.T, x.cells.select(F.col("cell_id").alias("gene_id"), F.lit(0).alias("k"), F.lit(4.0).alias("m"), F.lit(0.25).alias("z"))).select(F.col("cell_id").alias("gene_id"), "ll"), "ll")),
    }


def reduce_and(masks: list[DataFrame]) -> DataFrame:
    """(gene_id, is_nb): genes that all masks hold true."""
    out = masks[0]
    for more in masks[1:]:
        out = out.union(more)
    return out.groupBy("gene_id").agg(F.bool_and("is_nb").alias("is_nb"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    m = lambda fn: lambda s, d: fn(_x(s, d))
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "counts_long": m(lambda x: _entries(x)),
        "cell_totals": m(lambda x: _r(prep.cell_totals(x), "total")),
        "gene_totals": m(lambda x: _r(prep.gene_totals(x), "total")),
        "gene_mean_var": m(lambda x: _r(prep.gene_mean_var(x), "mean", "var")),
        "cell_normalize": m(lambda x: _entries(prep.cell_normalize(x))),
        "log_norm": m(lambda x: _entries(prep.log_norm(x))),
        "max_variance_genes": m(lambda x: prep.max_variance_genes(x).select("gene_id", "bin", "place")),
        "gene_subset": lambda s, d: _entries(_x(s, d).select_genes(_small_genes(s, d))),
        "gene_complement": lambda s, d: _entries(_x(s, d).drop_genes(_small_genes(s, d))),
        "nb_gene_mask": m(lambda x: prep.nb_genes(x)),
        "value_histogram": m(lambda x: prep.value_histogram(x)),
        "bounding_box": lambda s, d: _r(prep.bounding_box(tables.embedding_points(s, d)), "low", "high"),
        "poisson_ll": m(lambda x: _r(likelihood.poisson_ll(x, _means(x)), "ll")),
        "poisson_assign": m(lambda x: cluster.poisson_assign(x, _means(x))),
        "poisson_dist_mat": m(lambda x: _r(likelihood.poisson_dist_mat(x, _means(x)), "dist")),
        "nb_ll": m(lambda x: _r(likelihood.nb_ll(x, _means(x).select("gene_id", "k", F.lit(0.3).alias("p"), F.col("m").alias("r"))), "ll")),
        "zip_ll": m(lambda x: _r(likelihood.zip_ll(x, _means(x).withColumn("z", F.col("k") * 0.2)), "ll")),
        "poisson_objective": m(lambda x: _one(likelihood.poisson_objective(x, _means(x), _weights(x)))),
        "frobenius_cost": m(lambda x: _one(likelihood.frobenius_cost(x, _means(x), _weights(x)))),
        "poisson_test_w2": m(lambda x: _r(likelihood.poisson_test(x.entries.join(_labels(x), "cell_id").withColumn("side", F.least("cluster", F.lit(1))), "gene_id"), "w2")),
        "mdl": lambda s, d: s.createDataFrame([(round(likelihood.mdl(100.0, K, _x(s, d)), 4),)], "mdl double"),
        "cluster_means": m(lambda x: _r(cluster.cluster_means(x, _labels(x), K), "m")),
        "em_step": m(lambda x: cluster.em_step(x, _labels(x), K)),
        "zip_moments": m(lambda x: _r(cluster.zip_moments(x), "lam", "pi")),
        "nb_moments": m(lambda x: _r(dispersed.nb_moments(x), "p", "r")),
        "init_from_assignments": m(lambda x: _w_long(_labels(x).select("cell_id", vectors.soft_one_hot(F.col("cluster"), K).alias("w")))),
        "nolips_w_step": m(lambda x: _w_long(factor.sweep(x, _am(x), _aw(x), K))),
        "nolips_m_step": m(lambda x: _w_long(_sweep_m(x), "gene_id")),
        "nolips_regularized": m(lambda x: _w_long(factor.sweep(x, _am(x), _aw(x), K, 2.5))),
        "update_m_init": lambda s, d: _r(factor.update_m_init(_x(s, d), _means(_x(s, d)).join(_small_genes(s, d), "gene_id", "left_semi"), _weights(_x(s, d))), "m"),
        "fuzzy_weights": m(lambda x: _r(factor.fuzzy_weights(likelihood.poisson_dist_mat(x, _means(x))), "w")),
        "imputed_entries": m(lambda x: _r(_imputed(x), "value", "mw")),
        "imputation_error": m(lambda x: _one(evaluate.imputation_error(_imputed(x)))),
        "poisson_dist": _pair_distance(vectors.poisson_dist),
        "poisson_ll_2": _pair_distance(vectors.poisson_ll_2),
        "symmetric_kld": _pair_distance(vectors.symmetric_kld),
        "jensen_shannon": _pair_distance(vectors.jensen_shannon),
        "w_normalize": m(lambda x: _w_long(_am(x).select("gene_id", vectors.normalized(F.col("m")).alias("w")), "gene_id")),
        "diffusion_round": m(lambda x: _w_long(reduce.diffused(_aw(x), 1))),
        "state_distances": m(lambda x: _r(reduce.state_distances(_means(x)), "d")),
        "mds_projection": m(lambda x: _w_long(reduce.project(x.genes.sparkSession.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, -1.0]), (2, [0.5, 3.0])], "k int, x array<double>"), _aw(x)), value="x")),
        "curve_edges": lambda s, d: lineage.curve_edges(_points(s, d), "fx"),
        "nearest_links": lambda s, d: lineage.nearest_links(_points(s, d)),
        "pseudotime": lambda s, d: _r(lineage.pseudotime(0, tables.table(s, d, "nation").select((F.col("n_nationkey") + 0).cast("long").alias("src"), F.pmod(F.col("n_nationkey") * 2 + 1, F.lit(25)).cast("long").alias("dst")), tables.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell_id"), F.col("n_nationkey").cast("double").alias("fx"), F.col("n_regionkey").cast("double").alias("fy"))), "time"),
        "contingency": m(lambda x: evaluate.contingency(_labels(x), _true(x))),
        "purity": m(lambda x: _one(evaluate.purity(evaluate.contingency(_labels(x), _true(x))))),
        "nmi": m(lambda x: _one(evaluate.nmi(evaluate.contingency(_labels(x), _true(x))))),
        "ari": m(lambda x: _one(evaluate.ari(evaluate.contingency(_labels(x), _true(x))))),
        "nearest_neighbours": lambda s, d: _r(neighbours.nearest(_places(s, d), 5), "square"),
        "nne_projected": lambda s, d: _one(evaluate.nearest_label_accuracy(_places(s, d), "cell_id", "vec", "label")),
        "nne_1nn": lambda s, d: _one(evaluate.nearest_label_accuracy(tables.embedding_points(s, d), "cell_id", "vec", "label")),
        "binarize": m(lambda x: prior.binarize(_prior(x))),
        "missing_genes": m(lambda x: prior.missing_genes(_prior(x))),
        "mean_normalized_prior": m(lambda x: _r(prior.mean_normalized_prior(_prior(x).where("q >= 0"), 100.0), "m")),
        "qual_norm_output": m(lambda x: _r(prior.output_from_levels(_prior(x), x.genes.select("gene_id", F.pmod("gene_id", F.lit(5)).cast("double").alias("low"), (F.pmod("gene_id", F.lit(7)) + 5).cast("double").alias("high"))), "m")),
        "dist_fit_errors": _fit_errors,
        "special_functions": m(lambda x: _r(x.genes.select("gene_id", special.lgamma((F.col("gene_id") + 1) / 7.0).alias("lgamma"), special.log_ncr(F.col("gene_id") + 10.0, F.lit(3.5)).alias("log_ncr"), special.normal_pdf(F.col("gene_id") / 100.0, F.lit(1.0), F.lit(2.0)).alias("pdf"), special.poly_curve(F.col("gene_id") / 1000.0, F.array(*(F.lit(v) for v in (1.0, -2.0, 0.7310585)))).alias("poly"), special.fourier_series(F.col("gene_id") / 100.0, F.array(*(F.lit(v) for v in (1.0, 0.5, -0.25))), F.lit(2.0)).alias("fourier")), "lgamma", "log_ncr", "pdf", "poly", "fourier")),
        "libsvm_lines": m(lambda x: text.libsvm_lines(x)),
        "word_lines": m(lambda x: text.word_lines(x)),
        "event_counts": lambda s, d: _entries(tables.event_user(s, d)),
        "argmax_weights": m(lambda x: _am(x).select("gene_id", vectors.argmax(F.col("m")).alias("top"))),
    }
    return out | _iterative() | _columns()


_X = """x AS (SELECT l_partkey AS g, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
genes AS (SELECT p_partkey AS g FROM part), cells AS (SELECT s_suppkey AS c FROM supplier),
ks AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS k),
m AS (SELECT g, k, CAST(1 + (g * 7 + k * 3) % 11 AS DOUBLE) AS m FROM genes, ks),
w AS (SELECT c, k, CASE WHEN c % 3 = k THEN 0.75 ELSE 0.125 END::DOUBLE AS w FROM cells, ks),
lab AS (SELECT c, CAST(c % 3 AS INTEGER) AS cluster, CAST((c // 4) % 5 AS INTEGER) AS label FROM cells),
tot AS (SELECT cells.c, coalesce(sum(v), 0) AS total FROM cells LEFT JOIN x ON x.c = cells.c GROUP BY 1),
mv AS (SELECT genes.g, coalesce(sum(v), 0) / n AS mean, coalesce(sum(v * v), 0) / n - (coalesce(sum(v), 0) / n) ** 2 AS var
       FROM genes LEFT JOIN x ON x.g = genes.g, (SELECT count(*)::DOUBLE AS n FROM cells) GROUP BY genes.g, n),
mw AS (SELECT x.g, x.c, any_value(v) AS v, sum(m * w) AS mw FROM x JOIN m ON m.g = x.g JOIN w ON w.c = x.c AND w.k = m.k GROUP BY 1, 2),
prior AS (SELECT g, CAST(k AS INTEGER) AS k, CASE WHEN g % 17 = 0 THEN -1.0 ELSE (g * 5 + k * 7) % 9 END::DOUBLE AS q FROM genes, (SELECT unnest(range(4)) AS k)),
pts AS (SELECT vec_id AS cell_id, label AS cluster, round(CAST(embedding[1] AS DOUBLE), 6) AS fx, round(CAST(embedding[2] AS DOUBLE), 6) AS fy FROM embeddings)"""

_ASSIGN = "SELECT c AS cell_id, CAST(arg_max(k, (round(ll, 9), -k)) AS INTEGER) AS cluster FROM ll GROUP BY c"


def _center_sql(zero: str, diff: str, centers: str = "m") -> str:
    """(c, k, ll) by the term of an absent entry and an entry's difference to it."""
    return f"""(SELECT b.c, b.k, b.base + coalesce(d.d, 0) AS ll FROM (SELECT cells.c, z.k, z.base FROM cells, (SELECT k, sum({zero}) AS base FROM {centers} GROUP BY k) z) b
 LEFT JOIN (SELECT x.c, k, sum({diff}) AS d FROM x JOIN {centers} USING (g) GROUP BY 1, 2) d ON d.c = b.c AND d.k = b.k)"""


def _pair_sql(term: str) -> str:
    return f"SELECT c AS cell_id, round(sum({term}), 6) + 0.0 AS value FROM (SELECT c, w AS a, CASE WHEN (c + 1) % 3 = k THEN 0.5 ELSE 0.25 END::DOUBLE AS b FROM w) GROUP BY c"


def _sweep_sql(reg: float) -> str:
    return f"""SELECT w.c AS cell_id, w.k, round(CASE WHEN 1 + w / (2 * total + 1e-8) * ({reg} + sm - coalesce(pull, 0)) > 0 THEN w / (1 + w / (2 * total + 1e-8) * ({reg} + sm - coalesce(pull, 0))) ELSE 0 END, 6) + 0.0 AS value
FROM w JOIN tot ON tot.c = w.c JOIN (SELECT k, sum(m) AS sm FROM m GROUP BY k) s ON s.k = w.k
LEFT JOIN (SELECT mw.c, m.k, sum(m * v / (mw + 1e-10)) AS pull FROM mw JOIN m ON m.g = mw.g GROUP BY 1, 2) p ON p.c = w.c AND p.k = w.k"""


_POISSON = ("-m", "v * ln(m + 1e-10)")


def _means_sql(labels: str) -> str:
    """(g, k, m) of the clusters of a table (c, cluster); an empty one has the cell of least md5."""
    return f"""(SELECT m.g, m.k, CASE WHEN z.n IS NULL THEN coalesce(o.v, 0) ELSE coalesce(s, 0) / z.n END AS m FROM m
LEFT JOIN (SELECT cluster AS k, count(*) AS n FROM {labels} GROUP BY 1) z ON z.k = m.k
LEFT JOIN (SELECT g, cluster AS k, sum(v) AS s FROM x JOIN {labels} l ON l.c = x.c GROUP BY 1, 2) t ON t.g = m.g AND t.k = m.k
LEFT JOIN (SELECT g, v FROM x WHERE c = (SELECT arg_min(c, md5(CAST(c AS VARCHAR))) FROM cells)) o ON o.g = m.g)"""


def _assigned(scores: str) -> str:
    return f"(SELECT c, CAST(arg_max(k, (round(ll, 9), -k)) AS INTEGER) AS cluster FROM {scores} GROUP BY c)"


def _moments_sql(labels: str) -> str:
    """(g, k, mean, var) within each cluster that has cells."""
    return f"""(SELECT genes.g, z.k, coalesce(s1, 0) / n AS mean, coalesce(s2, 0) / n - (coalesce(s1, 0) / n) * (coalesce(s1, 0) / n) AS var
FROM genes, (SELECT cluster AS k, count(*)::DOUBLE AS n FROM {labels} GROUP BY 1) z
LEFT JOIN (SELECT g, cluster AS k, sum(v) AS s1, sum(v * v) AS s2 FROM x JOIN {labels} l ON l.c = x.c GROUP BY 1, 2) t ON t.g = genes.g AND t.k = z.k)"""


def _zip_sql(labels: str) -> str:
    return f"""(SELECT g, k, greatest(0.0, coalesce(mean + var / nullif(mean, 0) - 1, 0)) AS m,
 least(1.0, greatest(0.0, coalesce((var - mean) / nullif(mean * mean + var - mean, 0), 0))) AS z FROM {_moments_sql(labels)})"""


_ZIP = ("CASE WHEN z <= 0 THEN -m ELSE ln(z + (1 - z) * exp(-m)) END", "ln(greatest(1 - z, 1e-10)) + v * ln(m + 1e-10) - m - CASE WHEN z <= 0 THEN -m ELSE ln(z + (1 - z) * exp(-m)) END")


def _nb_sql(labels: str) -> str:
    """(g, k, m, p, r, nb): negative binomial where every cluster is over-dispersed."""
    return f"""(SELECT g, k, mean AS m, 1 - mean / nullif(var, 0) AS p, mean * (1 - (1 - mean / nullif(var, 0))) / nullif(1 - mean / nullif(var, 0), 0) AS r,
 bool_and(mean < 0.9 * var AND mean > 0) OVER (PARTITION BY g) AS nb FROM {_moments_sql(labels)})"""


_NB = ("CASE WHEN nb THEN r * ln(1 - p) ELSE -m END", "CASE WHEN nb THEN lgamma(r + v) - lgamma(r) + v * ln(p) ELSE v * ln(m + 1e-10) END")


def _rounds_sql(first: str, step: Callable[[str], str], score: tuple[str, str], rounds: int) -> str:
    """CTEs l0, p1, l1, ...: labels, parameters from labels, labels from parameters."""
    out = [f"l0 AS {first}"]
    for j in range(1, rounds + 1):
        out += [f"p{j} AS MATERIALIZED {step(f'l{j - 1}')}", f"l{j} AS MATERIALIZED {_assigned(_center_sql(*score, f'p{j}'))}"]
    return ",\n" + ",\n".join(out)


def _scored_sql(method: str, ctes: str, labels: str, top: bool = False) -> str:
    """The metrics of one method's labels (c, cluster) against ``lab``'s; as the whole query or as a part of one."""
    return f"""{ctes if top else "WITH " + ctes.lstrip(", ")},
jt AS (SELECT q.cluster, lab.label FROM {labels} q JOIN lab ON lab.c = q.c), ct AS (SELECT cluster, label, count(*) AS n FROM jt GROUP BY 1, 2),
tc AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY cluster) AS nc, sum(n) OVER (PARTITION BY label) AS nl FROM ct),
en AS (SELECT (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM jt) AS p FROM jt GROUP BY cluster)) AS hc, (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM jt) AS p FROM jt GROUP BY label)) AS hl, (SELECT sum(n / t * ln(n * t / (nc * nl))) FROM tc) AS mi),
ra AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM jt GROUP BY cluster)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM jt GROUP BY label)) AS b, (SELECT count(*) * (count(*) - 1) / 2 FROM jt) AS t)
SELECT 0 AS run, '{method}' AS method, metric, round(value, 6) + 0.0 AS value FROM (
 SELECT 'purity' AS metric, (SELECT sum(top) / sum(al) FROM (SELECT max(n) AS top, sum(n) AS al FROM ct GROUP BY cluster)) AS value
 UNION ALL SELECT 'nmi', mi / ((hc + hl) / 2) FROM en UNION ALL SELECT 'ari', (s - a * b / t) / ((a + b) / 2 - a * b / t) FROM ra)"""


def _moved_w(mc: str, wc: str, masked: bool = False) -> str:
    """(c, k, w) after one sweep."""
    push = "coalesce(push, 0)" if masked else "sm"
    d = f"(1 + w / (2 * total + 1e-8) * ({push} - coalesce(pull, 0)))"
    return f"""(SELECT a.c, a.k, CASE WHEN {d} > 0 THEN w / {d} ELSE 0 END AS w FROM {wc} a JOIN tot ON tot.c = a.c JOIN (SELECT k, sum(m) AS sm FROM {mc} GROUP BY k) s ON s.k = a.k
LEFT JOIN (SELECT e.c, q.k, sum(q.m * e.v / (e.mw + 1e-10)) AS pull, sum(q.m) AS push FROM (SELECT x.g, x.c, any_value(v) AS v, sum(m * w) AS mw FROM x JOIN {mc} i ON i.g = x.g JOIN {wc} j ON j.c = x.c AND j.k = i.k GROUP BY 1, 2) e JOIN {mc} q ON q.g = e.g GROUP BY 1, 2) p ON p.c = a.c AND p.k = a.k)"""


def _moved_m(mc: str, wc: str, masked: bool = False) -> str:
    """(g, k, m) after one sweep."""
    push = "coalesce(push, 0)" if masked else "sw"
    d = f"(1 + m / (2 * coalesce(t, 0) + 1e-8) * ({push} - coalesce(pull, 0)))"
    return f"""(SELECT a.g, a.k, CASE WHEN {d} > 0 THEN m / {d} ELSE 0 END AS m FROM {mc} a JOIN (SELECT k, sum(w) AS sw FROM {wc} GROUP BY k) s ON s.k = a.k LEFT JOIN (SELECT g, sum(v) AS t FROM x GROUP BY 1) z ON z.g = a.g
LEFT JOIN (SELECT e.g, q.k, sum(q.w * e.v / (e.mw + 1e-10)) AS pull, sum(q.w) AS push FROM (SELECT x.g, x.c, any_value(v) AS v, sum(m * w) AS mw FROM x JOIN {mc} i ON i.g = x.g JOIN {wc} j ON j.c = x.c AND j.k = i.k GROUP BY 1, 2) e JOIN {wc} q ON q.c = e.c GROUP BY 1, 2) p ON p.g = a.g AND p.k = a.k)"""


def _two_sql(masked: bool) -> str:
    """CTEs m0, w0, ... w2, m2: two rounds of one sweep from the fixed labels."""
    parts = [f"m0 AS MATERIALIZED (SELECT g, k, m + 1e-8 AS m FROM {_means_sql('lab')})", "w0 AS (SELECT c, k, w FROM w)"]
    for j in (1, 2):
        parts += [f"w{j} AS MATERIALIZED {_moved_w(f'm{j - 1}', f'w{j - 1}', masked)}", f"m{j} AS MATERIALIZED {_moved_m(f'm{j - 1}', f'w{j}', masked)}"]
    return ",\n" + ",\n".join(parts)


_NORMAL_W = "round(CASE WHEN sum(w) OVER (PARTITION BY c) > 0 THEN w / sum(w) OVER (PARTITION BY c) ELSE 1.0 / 3 END, 6) + 0.0"


def _nmf_sql(value: str) -> str:
    """Two updates of the weights, then they are scaled (the means' updates come after and don't matter)."""
    up = lambda a, b: f"{b} AS MATERIALIZED (SELECT a.c, a.k, any_value(a.w) * any_value(coalesce(t.top, 0)) / (sum(o.w * g.s) + 1e-12) AS w FROM {a} a JOIN {a} o ON o.c = a.c JOIN gram g ON g.i = a.k AND g.j = o.k LEFT JOIN tops t ON t.c = a.c AND t.k = a.k GROUP BY a.c, a.k)"
    return f""",
y AS (SELECT x.g, x.c, {value} AS v FROM x JOIN tot ON tot.c = x.c, (SELECT median(total) AS mid FROM tot)),
tops AS (SELECT y.c, m.k, sum(v * m) AS top FROM y JOIN m ON m.g = y.g GROUP BY 1, 2), gram AS (SELECT a.k AS i, b.k AS j, sum(a.m * b.m) AS s FROM m a JOIN m b ON a.g = b.g GROUP BY 1, 2),
{up("w", "u1")}, {up("u1", "u2")}
SELECT c AS cell_id, k, round(w / greatest(sum(w) OVER (PARTITION BY c), 1e-300), 6) + 0.0 AS value FROM u2"""


def _mds_sql(power: int) -> str:
    """Classical scaling of the three states in closed form, and cells by their weights to this power."""
    minors = "b00 * b11 - b01 * b01 + b00 * b22 - b02 * b02 + b11 * b22 - b12 * b12"
    vector = "SELECT *, [b01 * b12 - b02 * (b11 - e), b02 * b01 - (b00 - e) * b12, (b00 - e) * (b11 - e) - b01 * b01] AS v FROM"
    return f""",
cmx AS MATERIALIZED {_means_sql("lab")},
dd AS (SELECT a.k AS i, b.k AS j, sum((a.m - b.m) * (ln(a.m + 1e-10) - ln(b.m + 1e-10))) ** 2 AS q FROM cmx a JOIN cmx b ON a.g = b.g GROUP BY 1, 2),
bb AS (SELECT i, j, -0.5 * (q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER ()) AS b FROM dd),
flat AS (SELECT max(b) FILTER (WHERE i = 0 AND j = 0) AS b00, max(b) FILTER (WHERE i = 0 AND j = 1) AS b01, max(b) FILTER (WHERE i = 0 AND j = 2) AS b02, max(b) FILTER (WHERE i = 1 AND j = 1) AS b11, max(b) FILTER (WHERE i = 1 AND j = 2) AS b12, max(b) FILTER (WHERE i = 2 AND j = 2) AS b22 FROM bb),
eig AS (SELECT *, 0 AS d, ((b00 + b11 + b22) + sqrt((b00 + b11 + b22) ** 2 - 4 * ({minors}))) / 2 AS e FROM flat UNION ALL SELECT *, 1 AS d, ((b00 + b11 + b22) - sqrt((b00 + b11 + b22) ** 2 - 4 * ({minors}))) / 2 AS e FROM flat),
vec AS ({vector} eig),
un AS (SELECT d, e, v, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS len, list_aggregate(list_transform(v, lambda y: abs(y)), 'max') AS top FROM vec),
st AS (SELECT d, unnest(range(3)) AS k, unnest(v) / len * sqrt(greatest(e, 0)) * CASE WHEN list_contains(v, top) THEN 1 ELSE -1 END AS x FROM un),
raw AS (SELECT cells.c, ks.k, coalesce(sum(v), 0)::DOUBLE + 1 AS r FROM cells CROSS JOIN ks LEFT JOIN x ON x.c = cells.c AND x.g % 3 = ks.k GROUP BY 1, 2), sw AS (SELECT c, k, r ** {power} / sum(r ** {power}) OVER (PARTITION BY c) AS w FROM raw)
SELECT c AS cell_id, CAST(d AS INTEGER) AS k, round(round(sum(w * x), 6), 3) + 0.0 AS value FROM sw JOIN st ON st.k = sw.k GROUP BY 1, 2"""


def _kmeans_sql(seed: int) -> str:
    """k-means++ by the race of exponentials, then the cells' centers."""
    unit = lambda j: f"(CAST('0x' || substr(md5(c || ':{seed}:{j}'), 1, 10) AS BIGINT) + 1) / 1099511627777.0::DOUBLE"
    cell = lambda pick, j: f"SELECT genes.g, {j}::INTEGER AS k, CASE WHEN v > 0 THEN v ELSE 1e-10 END::DOUBLE AS m FROM genes LEFT JOIN (SELECT g, v FROM x WHERE c = (SELECT c FROM {pick})) o ON o.g = genes.g"
    far = ("(0 - m) * (ln(1e-10) - ln(m + 1e-10))", "(v - m) * (ln(v + 1e-10) - ln(m + 1e-10)) - (0 - m) * (ln(1e-10) - ln(m + 1e-10))")
    out = [f"k0 AS MATERIALIZED (SELECT arg_min(c, ({unit(-1)}, c)) AS c FROM cells)", f"s0 AS MATERIALIZED ({cell('k0', 0)})"]
    for j in (1, 2):
        taken = " UNION ALL ".join(f"SELECT c FROM k{i}" for i in range(j))
        out += [
            f"n{j} AS MATERIALIZED (SELECT c, min(ll) AS d FROM {_center_sql(*far, f's{j - 1}')} WHERE c NOT IN ({taken}) GROUP BY c)",
            f"k{j} AS MATERIALIZED (SELECT arg_min(c, (CASE WHEN d > 0 THEN -ln({unit(j)}) / (d * d) ELSE 'infinity'::DOUBLE END, c)) AS c FROM n{j})",
            f"s{j} AS MATERIALIZED (SELECT * FROM s{j - 1} UNION ALL {cell(f'k{j}', j)})",
        ]
    return ",\n" + ",\n".join(out) + f"\nSELECT c AS cell_id, cluster FROM {_assigned(_center_sql(*_POISSON, 's2'))}"


_LEVELS = """,
dn AS (SELECT genes.g, cells.c, coalesce(v, 0)::DOUBLE AS v FROM genes, cells LEFT JOIN x ON x.g = genes.g AND x.c = cells.c),
so AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i, count(*) OVER (PARTITION BY g) AS n, sum(v) OVER (PARTITION BY g) AS t, lead(v) OVER (PARTITION BY g ORDER BY v) AS nx, sum(v) OVER (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING) AS s FROM dn),
cu AS (SELECT g, arg_max(i, (round(s * ln(s / i + 1e-10) + (t - s) * ln((t - s) / (n - i) + 1e-10), 9), -i)) AS cut FROM so WHERE i < n AND nx <> v GROUP BY g),
lv AS (SELECT so.g, coalesce(median(v) FILTER (WHERE cut IS NULL OR i <= cut), 0) AS low, coalesce(median(v) FILTER (WHERE cut IS NULL OR i > cut), 0) AS high,
 sum(v + 1e-5) FILTER (WHERE i <= cut) AS a, sum(v + 1e-5) FILTER (WHERE i > cut) AS b, count(*) FILTER (WHERE i <= cut)::DOUBLE AS ka, count(*) FILTER (WHERE i > cut)::DOUBLE AS kb FROM so LEFT JOIN cu ON cu.g = so.g GROUP BY so.g),
le AS (SELECT g, low, high, coalesce((b - a * kb / ka) / sqrt((a + b) * kb / ka), 0) AS w2 FROM lv)"""


def _landmark_sql(n: int) -> str:
    """Poisson distances of all cells to the first n, all genes."""
    return f"""lm AS (SELECT c AS l FROM cells ORDER BY c LIMIT {n}),
ld AS (
  SELECT cells.c, lm.l, sum((coalesce(a.v, 0) - coalesce(b.v, 0)) * ln((coalesce(a.v, 0) + 1e-10) / (coalesce(b.v, 0) + 1e-10))) AS d
  FROM cells CROSS JOIN lm CROSS JOIN genes LEFT JOIN x a ON a.g = genes.g AND a.c = cells.c LEFT JOIN x b ON b.g = genes.g AND b.c = lm.l GROUP BY 1, 2)"""


def _qual_sql(gaussian: bool) -> str:
    """(gene_id, k, m): levels by the prior, and of missing genes the means of one assignment by the others."""
    levels, limit = _LEVELS, "lo + (hi - lo) / 2"
    if gaussian:
        limit = "(hi - lo) / 2"
        levels = levels.replace("round(s * ln(s / i + 1e-10) + (t - s) * ln((t - s) / (n - i) + 1e-10), 9)", "round(s * (s / i) + (t - s) * ((t - s) / (n - i)), 9)")
        levels = levels.replace("coalesce(median(v) FILTER (WHERE cut IS NULL OR i <= cut), 0) AS low", "avg(v) FILTER (WHERE cut IS NULL OR i <= cut) AS low")
        levels = levels.replace("coalesce(median(v) FILTER (WHERE cut IS NULL OR i > cut), 0) AS high", "avg(v) FILTER (WHERE cut IS NULL OR i > cut) AS high")
    scores = "(SELECT c, k, -ll AS ll FROM " + _center_sql("m * m", "-2 * v * m", "ql") + ")" if gaussian else _center_sql("-m", "v * ln(m + 1e-10)", "ql")
    return levels + f""",
pe AS (SELECT g, k, q, min(q) OVER (PARTITION BY g) AS lo, max(q) OVER (PARTITION BY g) AS hi FROM prior),
ql AS MATERIALIZED (SELECT pe.g, pe.k, CASE WHEN q > {limit} THEN high ELSE low END AS m FROM pe JOIN le ON le.g = pe.g WHERE NOT (lo = -1 AND hi = -1)),
l1 AS MATERIALIZED {_assigned(scores)},
z1 AS (SELECT cluster AS k, count(*) AS n FROM l1 GROUP BY 1),
s1 AS (SELECT g, cluster AS k, sum(v) AS s FROM x JOIN l1 ON l1.c = x.c GROUP BY 1, 2),
g1 AS (SELECT genes.g, coalesce(sum(v), 0) / (SELECT count(*) FROM cells) AS mean FROM genes LEFT JOIN x ON x.g = genes.g GROUP BY 1)
SELECT g AS gene_id, k, round(m, 6) + 0.0 AS m FROM ql UNION ALL
SELECT pe.g, pe.k, round(CASE WHEN n IS NULL THEN mean ELSE coalesce(s, 0) / n END, 6) + 0.0 FROM pe JOIN g1 ON g1.g = pe.g LEFT JOIN z1 ON z1.k = pe.k LEFT JOIN s1 ON s1.g = pe.g AND s1.k = pe.k WHERE lo = -1 AND hi = -1"""


#: The likelihood's slope in r at the middle of each gene's bracket in ln r, halved 48 times; digamma(r + x) - digamma(r) is a sum of x terms.
_NB_FIT_SQL = """,
st AS (SELECT genes.g, coalesce(sum(v), 0) / t.n AS mean, coalesce(sum(v * v), 0) / t.n - (coalesce(sum(v), 0) / t.n) ** 2 AS var, any_value(t.n) AS n FROM genes LEFT JOIN x ON x.g = genes.g, (SELECT count(*)::DOUBLE AS n FROM cells) t GROUP BY genes.g, t.n),
more AS (SELECT g, i, count(*)::DOUBLE AS c FROM (SELECT g, unnest(range(CAST(v AS BIGINT))) AS i FROM x) GROUP BY 1, 2),
terms AS (SELECT g, list(c ORDER BY i) AS cs FROM more GROUP BY g),
b0 AS (SELECT st.g, mean, n, cs, ln(greatest(mean ** 2 / (var - mean), 1e-6)) AS u FROM st JOIN terms ON terms.g = st.g WHERE var > mean AND mean > 0),
walk AS (
  SELECT g, u - 6.0 AS lo, u + 6.0 AS hi, 0 AS steps FROM b0 UNION ALL
  SELECT g, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, steps + 1
  FROM (SELECT w.g, lo, hi, steps, (lo + hi) / 2 AS mid, list_sum(list_transform(cs, lambda c, i: c / (exp((lo + hi) / 2) + i - 1))) + n * ln(exp((lo + hi) / 2) / (exp((lo + hi) / 2) + mean)) > 0 AS up FROM walk w JOIN b0 ON b0.g = w.g WHERE steps < 48))
SELECT genes.g AS gene_id, round(mean / (exp((lo + hi) / 2) + mean), 6) AS p, round((lo + hi) / 2, 6) + 0.0 AS log_r FROM genes LEFT JOIN (SELECT walk.*, mean FROM walk JOIN b0 ON b0.g = walk.g WHERE steps = 48) f ON f.g = genes.g"""

def _nb_state_sql(rounds: int, updates: int) -> str:
    """Weights after so many rounds of updates of all weights and then of all means, over all genes and cells; the last round's means don't move them."""
    at = ", ".join(f"max(CASE WHEN k = {j} THEN {{0}} END) AS y{j}" for j in range(3))
    last, up = (2 * rounds - 1) * updates, f"((step // {updates}) % 2 = 0)"
    return f""",
m0 AS (SELECT g, k, m + 1e-8 AS m FROM {_means_sql("lab")}),
pl AS MATERIALIZED (SELECT cells.c, genes.g, coalesce(v, 0) AS v, 1.0::DOUBLE + genes.g % 5 AS r FROM genes CROSS JOIN cells LEFT JOIN x ON x.g = genes.g AND x.c = cells.c),
walk AS (
 SELECT 0 AS step, true AS cell, c AS id, {at.format("w")} FROM w GROUP BY c UNION ALL SELECT 0, false, g, {at.format("m")} FROM m0 GROUP BY g
 UNION ALL (
  SELECT step + 1, up, id, {", ".join(f"o{j} * a{j} / (b{j} + 1e-12)" for j in range(3))} FROM (
   SELECT any_value(step) AS step, up, id, {", ".join(f"any_value(o{j}) AS o{j}, sum(v / d * f{j}) AS a{j}, sum((v + r) / (d + r) * f{j}) AS b{j}" for j in range(3))} FROM (
    SELECT cw.step, {up.replace("step", "cw.step")} AS up, CASE WHEN up THEN pl.c ELSE pl.g END AS id, v, r, cw.y0 * gm.y0 + cw.y1 * gm.y1 + cw.y2 * gm.y2 + 1e-10 AS d,
     {", ".join(f"CASE WHEN up THEN cw.y{j} ELSE gm.y{j} END AS o{j}, CASE WHEN up THEN gm.y{j} ELSE cw.y{j} END AS f{j}" for j in range(3))}
    FROM pl JOIN (SELECT * FROM walk WHERE cell AND step < {last}) cw ON cw.id = pl.c JOIN (SELECT * FROM walk WHERE NOT cell) gm ON gm.id = pl.g) GROUP BY up, id)
  UNION ALL SELECT step + 1, cell, id, y0, y1, y2 FROM walk WHERE cell <> {up} AND step < {last}))
SELECT id AS cell_id, k, round([y0, y1, y2][k + 1] / greatest(y0 + y1 + y2, 1e-300), 6) + 0.0 AS value FROM walk, ks WHERE cell AND step = {last}"""


_NOISY_SQL = f""",
cmx AS MATERIALIZED {_means_sql("lab")},
base AS MATERIALIZED {_assigned(_center_sql(*_POISSON, centers="cmx"))},
runs AS MATERIALIZED (SELECT run, c, CAST((cluster + run + CASE WHEN (c + 2 * run) % 7 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) AS cluster FROM base, (SELECT unnest(range(5))::INTEGER AS run)),
ov AS MATERIALIZED (SELECT a.run, a.cluster, b.run AS other_run, b.cluster AS other, count(*) AS n FROM runs a JOIN runs b ON a.c = b.c GROUP BY 1, 2, 3, 4)"""


_NEAR_SQL = """, pl AS (SELECT vec_id AS a, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
near AS (
  SELECT p.a, q.a AS b, p.label AS la, q.label AS lb, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d,
         row_number() OVER (PARTITION BY p.a ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.a) AS rank
  FROM pl p JOIN pl q ON p.a <> q.a)"""


def oracle_sql() -> dict[str, str]:
    dist = _center_sql("(0 - m) * (ln(1e-10) - ln(m + 1e-10))", "(v - m) * (ln(v + 1e-10) - ln(m + 1e-10)) - (0 - m) * (ln(1e-10) - ln(m + 1e-10))")
    table = "(SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2)"
    body = {
        "counts_long": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x",
        "cell_totals": "SELECT c AS cell_id, round(total, 6) AS total FROM tot",
        "gene_totals": "SELECT genes.g AS gene_id, round(coalesce(sum(v), 0), 6) AS total FROM genes LEFT JOIN x ON x.g = genes.g GROUP BY 1",
        "gene_mean_var": "SELECT g AS gene_id, round(mean, 6) AS mean, round(var, 6) + 0.0 AS var FROM mv",
        "cell_normalize": "SELECT g AS gene_id, x.c AS cell_id, round(v / total * (SELECT median(total) FROM tot), 6) AS value FROM x JOIN tot ON tot.c = x.c",
        "log_norm": "SELECT g AS gene_id, x.c AS cell_id, round(ln(1 + v / total * (SELECT median(total) FROM tot)), 6) AS value FROM x JOIN tot ON tot.c = x.c",
        "max_variance_genes": """SELECT g AS gene_id, CAST(bin AS INTEGER) AS bin, CAST(row_number() OVER (ORDER BY bin, vr DESC) - 1 AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY bin ORDER BY var DESC, g) AS vr FROM (
    SELECT *, least(rn // greatest(n // 5, 1), 4) AS bin FROM (SELECT *, row_number() OVER (ORDER BY mean, g) - 1 AS rn, count(*) OVER () AS n FROM mv)))
WHERE vr <= floor(greatest(n // 5, 1) * 0.2) AND var > 0""",
        "gene_subset": "SELECT x.g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x JOIN part ON p_partkey = x.g WHERE p_size <= 10",
        "gene_complement": "SELECT x.g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x JOIN part ON p_partkey = x.g WHERE p_size > 10",
        "nb_gene_mask": "SELECT g AS gene_id, mean < 0.9 * var AS is_nb FROM mv",
        "value_histogram": """SELECT t.g AS gene_id, CAST(t.bin AS INTEGER) AS bin, CASE WHEN t.bin = 0 THEN (SELECT count(*) FROM cells) - t.nz ELSE coalesce(h.n, 0) END AS n
FROM (SELECT g, nz, unnest(range(CAST(top AS BIGINT) + 1)) AS bin FROM (SELECT genes.g, coalesce(max(round(v)), 0) AS top, count(v) FILTER (WHERE round(v) > 0) AS nz FROM genes LEFT JOIN x ON x.g = genes.g GROUP BY 1)) t
LEFT JOIN (SELECT g, CAST(round(v) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1, 2) h ON h.g = t.g AND h.bin = t.bin""",
        "bounding_box": "SELECT CAST(i AS INTEGER) AS k, round(min(CAST(e AS DOUBLE)), 6) AS low, round(max(CAST(e AS DOUBLE)), 6) AS high FROM (SELECT unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i",
        "poisson_ll": f"SELECT c AS cell_id, k, round(ll, 6) AS ll FROM {_center_sql('-m', 'v * ln(m + 1e-10)')}",
        "poisson_assign": f"WITH ll AS {_center_sql('-m', 'v * ln(m + 1e-10)')} {_ASSIGN}",
        "poisson_dist_mat": f"SELECT c AS cell_id, k, round(ll, 6) AS dist FROM {dist}",
        "nb_ll": f"SELECT c AS cell_id, k, round(ll, 6) AS ll FROM {_center_sql('m * ln(0.7)', 'lgamma(m + v) - lgamma(m) + v * ln(0.3)')}",
        "zip_ll": f"""WITH z AS (SELECT g, k, m, k * 0.2 AS z FROM m) SELECT c AS cell_id, k, round(ll, 6) AS ll FROM {_center_sql("CASE WHEN z <= 0 THEN -m ELSE ln(z + (1 - z) * exp(-m)) END", "ln(greatest(1 - z, 1e-10)) + v * ln(m + 1e-10) - m - CASE WHEN z <= 0 THEN -m ELSE ln(z + (1 - z) * exp(-m)) END", "z")}""",
        "poisson_objective": "SELECT round(((SELECT sum(sm * sw) FROM (SELECT k, sum(m) AS sm FROM m GROUP BY k) a JOIN (SELECT k, sum(w) AS sw FROM w GROUP BY k) b USING (k)) - (SELECT sum(v * ln(mw + 1e-10)) FROM mw)) / (SELECT count(*) FROM genes), 6) AS cost",
        "frobenius_cost": "SELECT round(0.5 * sum((coalesce(v, 0) - p) ** 2), 6) AS cost FROM (SELECT m.g, w.c, sum(m * w) AS p FROM m JOIN w ON w.k = m.k GROUP BY 1, 2) a LEFT JOIN x ON x.g = a.g AND x.c = a.c",
        "poisson_test_w2": """SELECT gene_id, round((x1 - x0 * n1 / n0) / sqrt((x0 + x1) * n1 / n0), 6) AS w2 FROM (
SELECT x.g AS gene_id, sum(CASE WHEN x.c % 3 = 0 THEN v + 1e-5 ELSE 0 END) AS x0, sum(CASE WHEN x.c % 3 > 0 THEN v + 1e-5 ELSE 0 END) AS x1,
 sum(CASE WHEN x.c % 3 = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN x.c % 3 > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS n1 FROM x GROUP BY 1) WHERE n0 > 0 AND n1 > 0""",
        "mdl": "SELECT round(100.0 + (g * c + c * 3) * ln(t / (g * 3)), 4) AS mdl FROM (SELECT (SELECT count(*) FROM genes)::DOUBLE AS g, (SELECT count(*) FROM cells)::DOUBLE AS c, (SELECT sum(v) FROM x) AS t)",
        "cluster_means": "SELECT m.g AS gene_id, m.k, round(coalesce(s, 0) / n, 6) AS m FROM m JOIN (SELECT cluster AS k, count(*) AS n FROM lab GROUP BY 1) z ON z.k = m.k LEFT JOIN (SELECT g, cluster AS k, sum(v) AS s FROM x JOIN lab ON lab.c = x.c GROUP BY 1, 2) t ON t.g = m.g AND t.k = m.k",
        "em_step": f"""WITH cm AS (SELECT m.g, m.k, coalesce(s, 0) / n AS m FROM m JOIN (SELECT cluster AS k, count(*) AS n FROM lab GROUP BY 1) z ON z.k = m.k LEFT JOIN (SELECT g, cluster AS k, sum(v) AS s FROM x JOIN lab ON lab.c = x.c GROUP BY 1, 2) t ON t.g = m.g AND t.k = m.k),
ll AS {_center_sql('-m', 'v * ln(m + 1e-10)', 'cm')} {_ASSIGN}""",
        "zip_moments": "SELECT g AS gene_id, round(greatest(0, coalesce(mean + var / nullif(mean, 0) - 1, 0)), 6) + 0.0 AS lam, round(least(1, greatest(0, coalesce((var - mean) / nullif(mean * mean + var - mean, 0), 0))), 6) + 0.0 AS pi FROM mv",
        "nb_moments": "SELECT g AS gene_id, round(1 - mean / var, 6) AS p, round(mean * (mean / var) / (1 - mean / var), 6) AS r FROM mv WHERE var > mean AND mean > 0",
        "init_from_assignments": "SELECT c AS cell_id, k, CASE WHEN c % 3 = k THEN 0.75 ELSE 0.125 END::DOUBLE AS value FROM w",
        "nolips_w_step": _sweep_sql(0.0),
        "nolips_regularized": _sweep_sql(2.5),
        "nolips_m_step": """SELECT m.g AS gene_id, m.k, round(CASE WHEN d > 0 THEN m / d ELSE 0 END, 6) + 0.0 AS value FROM (
SELECT m.g, m.k, m, 1 + m / (2 * coalesce(t, 0) + 1e-8) * (sw - coalesce(pull, 0)) AS d FROM m JOIN (SELECT k, sum(w) AS sw FROM w GROUP BY k) s ON s.k = m.k
LEFT JOIN (SELECT g, sum(v) AS t FROM x GROUP BY 1) t ON t.g = m.g
LEFT JOIN (SELECT mw.g, w.k, sum(w * v / (mw + 1e-10)) AS pull FROM mw JOIN w ON w.c = mw.c GROUP BY 1, 2) p ON p.g = m.g AND p.k = m.k) m""",
        "update_m_init": "SELECT m.g AS gene_id, m.k, round(CASE WHEN p_size <= 10 THEN m ELSE coalesce(s, 0) END, 6) AS m FROM m JOIN part ON p_partkey = m.g LEFT JOIN (SELECT x.g, w.k, sum(v * w) AS s FROM x JOIN w ON w.c = x.c GROUP BY 1, 2) t ON t.g = m.g AND t.k = m.k",
        "fuzzy_weights": f"SELECT c AS cell_id, k, round(1 / greatest(ll, 1e-10) ** 2 / sum(1 / greatest(ll, 1e-10) ** 2) OVER (PARTITION BY c), 6) AS w FROM {dist}",
        "imputed_entries": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value, round(mw, 6) AS mw FROM mw",
        "imputation_error": """SELECT round(sqrt(avg((v - mw) ** 2)), 6) AS rmse, round(sqrt(avg(((v - mw) / v) ** 2)), 6) AS relative_rmse, round(corr(v, mw), 6) AS pearson, round(corr(rv, rm), 6) AS spearman
FROM (SELECT v, mw, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY mw) + (count(*) OVER (PARTITION BY mw) - 1) / 2.0 AS rm FROM mw)""",
        "poisson_dist": _pair_sql("(a - b) * ln((a + 1e-10) / (b + 1e-10))"),
        "poisson_ll_2": _pair_sql("-(b + 1e-10) + (a + 1e-10) * ln(b + 1e-10)"),
        "symmetric_kld": _pair_sql("a * log2(a / (b + 1e-10) + 1e-10) + b * log2(b / (a + 1e-10) + 1e-10)"),
        "jensen_shannon": _pair_sql("a * log2(a / ((a + b) / 2 + 1e-10)) + b * log2(b / ((a + b) / 2 + 1e-10))"),
        "w_normalize": "SELECT g AS gene_id, k, round(m / sum(m) OVER (PARTITION BY g), 6) AS value FROM m",
        "diffusion_round": "SELECT c AS cell_id, k, round(w * w / sum(w * w) OVER (PARTITION BY c), 6) AS value FROM w",
        "state_distances": "SELECT a.k AS i, b.k AS j, round(sum((a.m - b.m) * (ln(a.m + 1e-10) - ln(b.m + 1e-10))), 6) AS d FROM m a JOIN m b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2",
        "mds_projection": "SELECT c AS cell_id, CAST(d AS INTEGER) AS k, round(sum(w * x), 6) + 0.0 AS value FROM w JOIN (VALUES (0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, -1.0), (2, 0, 0.5), (2, 1, 3.0)) s(k, d, x) ON s.k = w.k GROUP BY 1, 2",
        "curve_edges": "SELECT * FROM (SELECT cell_id AS src, lead(cell_id) OVER (PARTITION BY cluster ORDER BY fx, cell_id) AS dst FROM pts) WHERE dst IS NOT NULL",
        "nearest_links": "SELECT e.src AS src, e.dst AS dst FROM (SELECT a.cluster, min({'d': round((a.fx - b.fx) ** 2 + (a.fy - b.fy) ** 2, 9), 'src': a.cell_id, 'dst': b.cell_id}) AS e FROM pts a JOIN pts b ON a.cluster <> b.cluster GROUP BY 1)",
        "pseudotime": """, n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation),
e0 AS (SELECT id AS src, (id * 2 + 1) % 25 AS dst FROM n), e1 AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0),
e AS (SELECT src, dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM e1 JOIN n a ON a.id = src JOIN n b ON b.id = dst),
walk AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS t, 0 AS steps UNION SELECT e.dst, min(walk.t + e.d), walk.steps + 1 FROM walk JOIN e ON e.src = walk.id WHERE walk.steps < 25 GROUP BY e.dst, walk.steps)
SELECT n.id AS cell_id, round(min(t), 6) AS time FROM n LEFT JOIN walk ON walk.id = n.id GROUP BY 1""",
        "contingency": "SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2",
        "purity": f"SELECT round(sum(top) / sum(a), 6) AS purity FROM (SELECT cluster, max(n) AS top, sum(n) AS a FROM {table} GROUP BY 1)",
        "nmi": f"""SELECT round(mi / ((hc + hl) / 2), 6) AS nmi FROM (SELECT
 (SELECT sum(n / t * ln(n * t / (nc * nl))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY cluster) AS nc, sum(n) OVER (PARTITION BY label) AS nl FROM {table})) AS mi,
 (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY cluster)) AS hc,
 (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY label)) AS hl)""",
        "ari": f"""SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 6) + 0.0 AS ari FROM (SELECT
 (SELECT sum(n * (n - 1) / 2) FROM {table}) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY cluster)) AS a,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY label)) AS b, (SELECT count(*) * (count(*) - 1) / 2 FROM lab) AS t)""",
        "nearest_neighbours": f"{_NEAR_SQL}\nSELECT a AS id, b AS other, round(d, 6) + 0.0 AS square, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 5",
        "nne_projected": f"{_NEAR_SQL}\nSELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0 END), 6) AS nne FROM near WHERE rank = 1",
        "lda_tokens": "SELECT 'gene' AS side, g AS id, CAST(sum(v) AS BIGINT) AS tokens FROM x GROUP BY g UNION ALL SELECT 'cell', c, CAST(sum(v) AS BIGINT) FROM x GROUP BY c",
        # all tokens of a cell start in its component
        "lda_warm_start": "SELECT cells.c AS cell_id, k, round((CASE WHEN cells.c % 3 = k THEN coalesce(t, 0) ELSE 0 END + 0.05) / (coalesce(t, 0) + 0.15), 6) + 0.0 AS value FROM cells CROSS JOIN (SELECT unnest(range(3))::INTEGER AS k) LEFT JOIN (SELECT c, sum(v) AS t FROM x GROUP BY c) s ON s.c = cells.c",
        "qual_norm": _qual_sql(False),
        "qual_norm_gaussian": _qual_sql(True),
        "nb_fit": _NB_FIT_SQL,
        "cluster_overlaps": _NOISY_SQL + "\nSELECT * FROM ov",
        # each cluster joins the cluster of the first run that it is likest to; those are the groups of so clear runs
        "consensus": _NOISY_SQL + """,
own AS (SELECT run, cluster, n FROM ov WHERE run = other_run AND cluster = other),
likest AS (SELECT ov.run, ov.cluster, arg_max(ov.other, round(ov.n / (a.n + b.n - ov.n), 9)) AS grp FROM ov JOIN own a ON a.run = ov.run AND a.cluster = ov.cluster JOIN own b ON b.run = ov.other_run AND b.cluster = ov.other WHERE ov.other_run = 0 GROUP BY 1, 2),
sh AS (SELECT c, grp, count(*) AS n FROM runs JOIN likest ON likest.run = runs.run AND likest.cluster = runs.cluster GROUP BY 1, 2)
SELECT c AS cell_id, arg_max(grp, (n, -grp)) AS cluster FROM sh GROUP BY c""",
        "landmark_distances": f", {_landmark_sql(16)}\nSELECT c AS cell_id, l AS landmark, round(d, 6) + 0.0 AS d FROM ld",
        "landmark_axis": f", {_landmark_sql(2)}\nSELECT p.c AS cell_id, 0 AS k, round((q.d ** 2 - p.d ** 2) / (2 * (SELECT max(d) FROM ld WHERE c IN (SELECT l FROM lm))), 6) + 0.0 AS value FROM ld p JOIN ld q ON p.c = q.c AND p.l < q.l",
        "nne_1nn": """, u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, any_value(a.label) AS la, any_value(b.label) AS lb, round(sum((a.e - b.e) ** 2), 9) AS d FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0 END), 6) AS nne FROM (SELECT a, any_value(la) AS la, arg_min(lb, (d, b)) AS lb FROM d GROUP BY a)""",
        "binarize": "SELECT g AS gene_id, k, CAST(q > lo + (hi - lo) / 2 AS INTEGER) AS high FROM (SELECT *, min(q) OVER (PARTITION BY g) AS lo, max(q) OVER (PARTITION BY g) AS hi FROM prior)",
        "missing_genes": "SELECT g AS gene_id FROM prior GROUP BY 1 HAVING max(q) = -1 AND min(q) = -1",
        "mean_normalized_prior": "SELECT g AS gene_id, k, round(q / sum(q) OVER (PARTITION BY k) * 100.0, 6) AS m FROM prior WHERE q >= 0",
        "qual_norm_output": "SELECT g AS gene_id, k, CASE WHEN q > lo + (hi - lo) / 2 THEN g % 7 + 5 ELSE g % 5 END::DOUBLE AS m FROM (SELECT *, min(q) OVER (PARTITION BY g) AS lo, max(q) OVER (PARTITION BY g) AS hi FROM prior)",
        "kmeans_pp": _kmeans_sql(1),
        "poisson_cluster": _rounds_sql(_assigned(_center_sql(*_POISSON)), _means_sql, _POISSON, 2) + "\nSELECT c AS cell_id, cluster FROM l2",
        "zip_cluster": _rounds_sql("(SELECT c, cluster FROM lab)", _zip_sql, _ZIP, 2) + "\nSELECT c AS cell_id, cluster FROM l2",
        "zip_cluster_params": f"SELECT g AS gene_id, k, round(m, 6) + 0.0 AS m, round(z, 6) + 0.0 AS z FROM {_zip_sql('lab')}",
        "nb_cluster": _rounds_sql("(SELECT c, cluster FROM lab)", _nb_sql, _NB, 2) + "\nSELECT c AS cell_id, cluster FROM l2",
        "run_state_estimation": _two_sql(False) + f"\nSELECT c AS cell_id, k, {_NORMAL_W} AS value FROM w2",
        "state_means": _two_sql(False) + "\nSELECT g AS gene_id, k, round(m, 6) + 0.0 AS value FROM m2",
        "zip_state_estimation": _two_sql(True) + f"\nSELECT c AS cell_id, k, {_NORMAL_W} AS value FROM w2",
        "nb_state_estimation": _nb_state_sql(10, 40),
        "norm_nmf": _nmf_sql("v / total * mid"),
        "log_norm_nmf": _nmf_sql("ln(1 + v / total * mid)"),
        "update_m": ",\nw0 AS (SELECT c, k, w FROM w)\nSELECT g AS gene_id, k, round(m, 6) + 0.0 AS value FROM " + _moved_m("m", "w0"),
        "mds": _mds_sql(1),
        "diffusion_mds": _mds_sql(4),
        "zip_fit": """, st AS (SELECT genes.g, count(v) AS np, coalesce(sum(v), 0) AS t, (SELECT count(*) FROM cells)::DOUBLE AS n FROM genes LEFT JOIN x ON x.g = genes.g GROUP BY 1),
walk AS (SELECT g, np, t, n, 0 AS step, CASE WHEN np = 0 THEN 0 ELSE t / np END::DOUBLE AS lam, CASE WHEN np = 0 THEN 1 ELSE 0.5 * (1 - np / n) END::DOUBLE AS pi FROM st
 UNION ALL SELECT g, np, t, n, step + 1, CASE WHEN np = 0 THEN 0 ELSE t / greatest(n - pi / (pi + (1 - pi) * exp(-lam)) * (n - np), 1e-12) END, CASE WHEN np = 0 THEN 1 ELSE pi / (pi + (1 - pi) * exp(-lam)) * (n - np) / n END FROM walk WHERE step < 200)
SELECT g AS gene_id, round(lam, 6) + 0.0 AS lam, round(pi, 6) + 0.0 AS pi FROM walk WHERE step = 200""",
        "qual_norm_levels": _LEVELS + "\nSELECT g AS gene_id, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(w2, 6) + 0.0 AS w2 FROM le",
        "qual_norm_filter_genes": _LEVELS + """, pe AS (SELECT g, k, q > min(q) OVER (PARTITION BY g) + (max(q) OVER (PARTITION BY g) - min(q) OVER (PARTITION BY g)) / 2 AS up, g % 17 = 0 AS gone FROM prior)
SELECT pe.g AS gene_id, k, round(CASE WHEN up THEN high ELSE low + 1e-5 END, 6) + 0.0 AS m FROM pe JOIN le ON le.g = pe.g WHERE NOT gone AND w2 >= 1.6448536269514722""",
        "hold_out": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x WHERE CAST('0x' || substr(md5(g || ':' || c || ':0'), 1, 12) AS BIGINT) % 1000000 < 100000",
        "dbscan": """, near AS MATERIALIZED (SELECT a.cell_id, b.cell_id AS other FROM pts a JOIN pts b ON (a.fx - b.fx) ** 2 + (a.fy - b.fy) ** 2 <= 0.05 * 0.05),
core AS MATERIALIZED (SELECT cell_id FROM near GROUP BY 1 HAVING count(*) >= 5), link AS MATERIALIZED (SELECT * FROM near WHERE cell_id IN (FROM core) AND other IN (FROM core)),
walk AS (SELECT cell_id, cell_id AS root FROM core UNION SELECT link.other, walk.root FROM walk JOIN link ON link.cell_id = walk.cell_id), lb AS (SELECT cell_id, min(root) AS cluster FROM walk GROUP BY 1),
bd AS (SELECT near.cell_id, min(lb.cluster) AS cluster FROM near JOIN lb ON lb.cell_id = near.other WHERE near.cell_id NOT IN (FROM core) GROUP BY 1)
SELECT pts.cell_id, coalesce(lb.cluster, bd.cluster, -1) AS cluster FROM pts LEFT JOIN lb ON lb.cell_id = pts.cell_id LEFT JOIN bd ON bd.cell_id = pts.cell_id""",
        "run_experiment": _scored_sql("none_em", _rounds_sql("(SELECT c, cluster FROM lab)", _means_sql, _POISSON, 1), "l1", True),
        "run_experiment_chains": "".join(", " + part for part in (
            "r1 AS (" + _scored_sql("none_em", _rounds_sql("(SELECT c, cluster FROM lab)", _means_sql, _POISSON, 1), "l1") + ")",
            "r2 AS (" + _scored_sql("none_em2", _rounds_sql("(SELECT c, cluster FROM lab)", _means_sql, _POISSON, 2), "l2") + ")",
            "r3 AS (" + _scored_sql("none_zip", _rounds_sql("(SELECT c, cluster FROM lab)", _zip_sql, _ZIP, 2), "l2") + ")",
            "r4 AS (" + _scored_sql("none_nb", _rounds_sql("(SELECT c, cluster FROM lab)", _nb_sql, _NB, 2), "l2") + ")",
            "r5 AS (" + _scored_sql("states_argmax", _two_sql(False), "(SELECT c, CAST(arg_max(k, w) AS INTEGER) AS cluster FROM w2 GROUP BY c)") + ")",
        )) + "\nSELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5",
        "nearest_weights": f"WITH nd AS {dist}, nw AS (SELECT c, arg_min(k, (round(ll, 9), k)) AS top FROM nd GROUP BY c) SELECT c AS cell_id, k, CASE WHEN top = k THEN 0.75 ELSE 0.125 END::DOUBLE AS value FROM nw, ks",
        "nmf_start": f"WITH m0 AS MATERIALIZED {_means_sql('lab')} SELECT c AS cell_id, k, round(1 / greatest(ll, 1e-10) ** 2 / sum(1 / greatest(ll, 1e-10) ** 2) OVER (PARTITION BY c), 6) + 0.0 AS value FROM {_center_sql('(0 - m) * (ln(1e-10) - ln(m + 1e-10))', '(v - m) * (ln(v + 1e-10) - ln(m + 1e-10)) - (0 - m) * (ln(1e-10) - ln(m + 1e-10))', 'm0')}",
        "nb_objective": "SELECT round(sum((coalesce(v, 0) + r) * ln(d + r) - coalesce(v, 0) * ln(d)) / (SELECT count(*) FROM genes), 6) AS cost FROM (SELECT m.g, w.c, sum(m * w) + 1e-10 AS d, 1.0 + m.g % 5 AS r FROM m JOIN w ON w.k = m.k GROUP BY 1, 2) a LEFT JOIN x ON x.g = a.g AND x.c = a.c",
        "zip_objective": "SELECT round(-sum(CASE WHEN v > 0 THEN ln(1 - z + 1e-10) + v * ln(d + 1e-10) - d ELSE ln(z + (1 - z) * exp(-d) + 1e-10) END) / (SELECT count(*) FROM genes), 6) AS cost FROM (SELECT m.g, w.c, sum(m * w) AS d, (m.g % 5) / 10.0::DOUBLE AS z FROM m JOIN w ON w.k = m.k GROUP BY 1, 2) a LEFT JOIN x ON x.g = a.g AND x.c = a.c",
        "zinb_ll": f"""WITH z AS (SELECT g, k, m, k * 0.2 AS z FROM m) SELECT c AS cell_id, k, round(ll, 6) AS ll FROM {_center_sql("CASE WHEN z <= 0 THEN m * ln(0.7) ELSE ln(z + (1 - z) * exp(m * ln(0.7))) END", "ln(greatest(1 - z, 1e-10)) + lgamma(m + v) - lgamma(m) + v * ln(0.3) + m * ln(0.7) - CASE WHEN z <= 0 THEN m * ln(0.7) ELSE ln(z + (1 - z) * exp(m * ln(0.7))) END", "z")}""",
        "read_matrix_market": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x",
        "read_word_counts": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x",
        "read_dense": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x WHERE g BETWEEN 1 AND 8",
        "packed_round_trip": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x",
        "word_lines_dense": "SELECT cells.c AS cell_id, string_agg('G' || genes.g || ' ' || CAST(coalesce(v, 0) AS BIGINT) || ' ', '' ORDER BY genes.g) AS line FROM cells JOIN genes ON genes.g <= 20 LEFT JOIN x ON x.c = cells.c AND x.g = genes.g GROUP BY 1",
        "model_lines": "SELECT g AS gene_id, g || ' ' || coalesce(string_agg(k || ':' || CAST(m - 3 AS VARCHAR) || ' ', '' ORDER BY k) FILTER (WHERE m >= 3), '') AS line FROM m GROUP BY g",
        "dictionary_lines": "SELECT i AS gene_id, i || chr(9) || 'G' || i || chr(9) || (i + 1) AS line FROM (SELECT unnest(range((SELECT count(*) FROM genes))) AS i)",
        "read_topic_lines": "SELECT g AS gene_id, k, round(m, 6) AS value FROM m",
        "read_word_topics": "SELECT g AS gene_id, k, round(m, 6) AS value FROM m",
        "read_document_topics": "SELECT c AS cell_id, k, round(w, 6) AS value FROM w",
        "cell_subset": "SELECT g AS gene_id, c AS cell_id, round(v, 6) AS value FROM x WHERE c % 3 = 1",
        "exp10": "SELECT g AS gene_id, c AS cell_id, round(10 ** (v / 100) - 1, 6) + 0.0 AS value FROM x",
        "relu": "SELECT g AS gene_id, c AS cell_id, round(v - 25, 6) AS value FROM x WHERE v > 25",
        "distinct_labels": "SELECT DISTINCT label FROM lab",
        "nb_genes_of_all_clusters": f"SELECT g AS gene_id, bool_and(mean < 0.9 * var) AS is_nb FROM {_moments_sql('lab')} GROUP BY 1",
        "zip_row_ll": "SELECT genes.g AS gene_id, round((SELECT count(*) FROM cells) * ln(0.25 + 0.75 * exp(-4.0)) + coalesce(sum(ln(0.75) + v * ln(4 + 1e-10) - 4 - ln(0.25 + 0.75 * exp(-4.0))), 0), 6) AS ll FROM genes LEFT JOIN x ON x.g = genes.g GROUP BY 1",
        "dist_fit_errors": """, nn AS (SELECT count(*)::DOUBLE AS n FROM cells),
st AS (SELECT genes.g, coalesce(sum(v), 0) / n AS mu, sqrt(greatest((coalesce(sum(v * v), 0) - coalesce(sum(v), 0) ** 2 / n) / (n - 1), 0)) AS sd,
 coalesce(sum(ln(1 + v)), 0) / n AS lmu, sqrt(greatest((coalesce(sum(ln(1 + v) ** 2), 0) - coalesce(sum(ln(1 + v)), 0) ** 2 / n) / (n - 1), 0)) AS lsd, coalesce(max(v), 0) AS top, n - count(v) AS zeros FROM genes LEFT JOIN x ON x.g = genes.g, nn GROUP BY genes.g, n),
b AS (SELECT *, unnest(range(CAST(top AS BIGINT) + 1)) AS i FROM st),
f AS (SELECT b.g, b.i, CASE WHEN b.i = 0 THEN zeros ELSE coalesce(h.k, 0) END / n AS f,
 CASE WHEN mu > 0 THEN exp(b.i * ln(mu) - mu - lgamma(b.i + 1)) ELSE (b.i = 0)::INTEGER END AS p,
 CASE WHEN sd > 0 THEN exp(-0.5 * ((b.i - mu + 1) / sd) ** 2) ELSE 0 END AS q, CASE WHEN lsd > 0 THEN exp(-0.5 * ((b.i - lmu) / lsd) ** 2) ELSE 0 END AS r
 FROM b LEFT JOIN (SELECT g, CAST(v AS BIGINT) AS i, count(*) AS k FROM x GROUP BY 1, 2) h ON h.g = b.g AND h.i = b.i, nn),
s AS (SELECT *, p / nullif(sum(p) OVER (PARTITION BY g), 0) AS pp, q / nullif(sum(q) OVER (PARTITION BY g), 0) AS qq, r / nullif(sum(r) OVER (PARTITION BY g), 0) AS rr FROM f)
SELECT g AS gene_id, round(sqrt(sum((f - coalesce(pp, 0)) ** 2)), 6) AS poiss, round(sqrt(sum((f - coalesce(qq, 0)) ** 2)), 6) AS norm, round(sqrt(sum((f - coalesce(rr, 0)) ** 2)), 6) AS lognorm FROM s GROUP BY 1""",
        "special_functions": """SELECT g AS gene_id, round(lgamma((g + 1) / 7.0), 6) AS lgamma, round(lgamma(g + 11.0) - lgamma(4.5) - lgamma(g + 7.5), 6) AS log_ncr,
 round(exp(-0.5 * ((g / 100.0 - 1) / 2) ** 2) / (2 * sqrt(2 * pi())), 6) AS pdf, round(1 - 2 * (g / 1000.0) + 0.7310585 * (g / 1000.0) ** 2, 6) + 0.0 AS poly, round(0.5 + 0.5 * sin(2 * g / 100.0) - 0.25 * cos(2 * g / 100.0), 6) + 0.0 AS fourier FROM genes""",
        "libsvm_lines": "SELECT cells.c AS cell_id, '1' || chr(9) || coalesce(string_agg(g || ':' || CAST(v AS BIGINT) || ' ', '' ORDER BY g), '') AS line FROM cells LEFT JOIN x ON x.c = cells.c GROUP BY 1",
        "word_lines": "SELECT cells.c AS cell_id, coalesce(string_agg('G' || g || ' ' || CAST(v AS BIGINT) || ' ', '' ORDER BY g), '') AS line FROM cells LEFT JOIN x ON x.c = cells.c GROUP BY 1",
        "event_counts": "SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS gene_id, user_id AS cell_id, count(*)::DOUBLE AS value FROM events GROUP BY event_type, user_id",
        "argmax_weights": "SELECT g AS gene_id, CAST(arg_max(k, (m, -k)) AS INTEGER) AS top FROM m GROUP BY 1",
    }
    errors = body["dist_fit_errors"]
    best = "CASE WHEN poiss <= least(norm, lognorm) THEN 'poiss' WHEN norm <= lognorm THEN 'norm' ELSE 'lognorm' END AS dist"
    head, _, tail = errors.rpartition("SELECT g AS gene_id")
    body["dist_fit_best"] = f"{head}SELECT gene_id, {best} FROM (SELECT g AS gene_id{tail})"
    return {name: _complete(sql) for name, sql in body.items()}


def _complete(sql: str) -> str:
    if sql.startswith("WITH "):
        return f"WITH {_X},\n{sql[5:]}"
    return f"WITH {'RECURSIVE ' if 'walk AS' in sql else ''}{_X}{sql}" if sql.startswith(",") else f"WITH {_X}\n{sql}"
