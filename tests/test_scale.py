"""What larger tables showed: rules and forms that must not depend on the size of the input."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import matrix

from tallymix.operators import dispersed, embed, factor, fitdist, lda, likelihood, lineage, reduce, store
from tallymix.operators.matrix import CountMatrix


def test_least_error_counts_to_six_places(spark):
    """The normal density's error is the least by 5e-7, the Poisson one's is the same to 6 places and goes first."""
    x = np.zeros((1, 834))
    x[0, :9], x[0, 9:19] = 1, 2
    m = matrix(spark, x)
    e = fitdist.fit_errors(m).first()
    assert e.norm < e.poiss and round(e.norm, 6) == round(e.poiss, 6)
    assert [r.dist for r in fitdist.best_distribution(m).collect()] == ["poiss"]


def _long(spark, x, key, value):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], f"{key} long, k int, {value} double")


def test_dense_objectives_by_blocks(spark, monkeypatch):
    """The sums over all genes and cells, with equal rows counted and small blocks, against dense arrays."""
    monkeypatch.setattr(dispersed, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dispersed, "BLOCK_PRODUCTS", 8)
    rng = np.random.default_rng(4)
    x, mm, w = rng.poisson(0.7, (13, 9)).astype(float), rng.random((13, 3)) + 0.1, rng.random((9, 3))
    mm[5:9], w[3:6] = mm[5], w[3]
    r, z = 1.0 + np.arange(13) % 3, (np.arange(13) % 3) / 10
    m, means, weights = matrix(spark, x), _long(spark, mm, "gene_id", "m"), _long(spark, w, "cell_id", "w")
    side = lambda v, name: spark.createDataFrame([(g, float(y)) for g, y in enumerate(v)], f"gene_id long, {name} double")
    d, rr, zz = mm @ w.T, r[:, None], z[:, None]
    want = ((x + rr) * np.log(d + rr + 1e-10) - x * np.log(d + 1e-10)).sum() / 13
    assert np.isclose(dispersed.nb_objective(m, means, weights, side(r, "r")).first().cost, want, rtol=1e-12)
    want = -np.where(x > 0, np.log(1 - zz + 1e-10) + x * np.log(d + 1e-10) - d, np.log(zz + (1 - zz) * np.exp(-d) + 1e-10)).sum() / 13
    assert np.isclose(dispersed.zip_objective(m, means, weights, side(z, "z")).first().cost, want, rtol=1e-12)
    assert dispersed._blocks(means.groupBy("gene_id").agg(F.collect_list("m").alias("m")), "m").count() >= 3


def test_poisson_objective_makes_no_row_per_entry_and_component(spark):
    x = np.arange(12.0).reshape(4, 3)
    means, weights = _long(spark, np.ones((4, 2)), "gene_id", "m"), _long(spark, np.full((3, 2), 0.5), "cell_id", "w")
    df = likelihood.poisson_objective(matrix(spark, x), means, weights)
    assert np.isclose(df.first().cost, 12 / 4, atol=1e-8)
    assert "first(value" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_imputing_walk_is_sent_or_joined(spark, monkeypatch):
    """Genes walked inside their tasks, in small slices, equal the joins; nothing as large as the result is stored."""
    rng = np.random.default_rng(8)
    m = matrix(spark, rng.poisson(0.4, (15, 40)))
    rows = lambda df: {(r.gene_id, r.cell_id): r.value for r in df.collect()}
    monkeypatch.setattr(reduce, "WALK_PLACES", 100)
    monkeypatch.setattr(reduce, "WALK_MOVES", 17)
    calls = []
    keep = reduce.stored
    monkeypatch.setattr(reduce, "stored", lambda df, *a: calls.append(df.columns) or keep(df, *a))
    one = rows(reduce.diffusion_impute(m, 3, 2, 5, 3))
    assert ["gene_id", "cell_id", "value"] not in calls
    monkeypatch.setattr(factor, "FACTOR_BYTES", 1000)
    other = rows(reduce.diffusion_impute(m, 3, 2, 5, 3))
    assert ["gene_id", "cell_id", "value"] in calls
    assert one.keys() == other.keys() and np.allclose([one[k] for k in one], [other[k] for k in one], rtol=1e-9)


def test_singular_vectors_go_by_the_shorter_side(spark, monkeypatch):
    """With more genes than cells only cells x n numbers meet; scores, right vectors and values are numpy's."""
    sizes, times = [], factor._gram_times
    monkeypatch.setattr(factor, "_gram_times", lambda packed, ids, q, *a: sizes.append(q.shape) or times(packed, ids, q, *a))
    x = np.random.default_rng(2).poisson(1.5, (50, 9)).astype(float)
    for centred in (False, True):
        a = x.T - (x.T.mean(0) if centred else 0)
        left, values, right = np.linalg.svd(a, full_matrices=False)
        got, vectors, sigma = factor.truncated_svd(matrix(spark, x), 9, passes=2, centred=centred)
        scores = np.array([r.vec for r in got.orderBy("cell_id").collect()])
        assert np.allclose(sigma[:8], values[:8]) and np.allclose(np.abs(scores[:, :8]), np.abs(left * values)[:, :8], atol=1e-6)
        assert np.allclose(np.abs([r.vec for r in vectors.orderBy("gene_id").collect()])[:, :8], np.abs(right[:8].T), atol=1e-6)
        assert set(sizes) == {(9, 9)}


def test_topics_take_no_time_by_token(spark, monkeypatch):
    """Entries of a billion tokens: the draws keep them, on either side's bundles; beyond FACTOR_BYTES tokens are sampled."""
    x = np.array([[1e9, 0, 3e8, 5], [2e9, 7, 0, 0]])
    for a in (x, x.T):
        state = lda.sampled(matrix(spark, a), 2, 0.1, 0.01, 2, 1).collect()
        assert {(r.gene_id, r.cell_id): sum(r.z) for r in state} == {(i, j): int(a[i, j]) for i, j in zip(*a.nonzero())}
        assert all(sum(r.kept) == sum(r.z) for r in state)
    monkeypatch.setattr(lda, "FACTOR_BYTES", 0)
    assert sum(sum(r.z) for r in lda.sampled(matrix(spark, np.minimum(x, 9)), 2, 0.1, 0.01, 1, 0).collect()) == 39


def test_far_clusters_link_by_few_pairs(spark, monkeypatch):
    """Three far rows of places, near copies among them: the links are brute force's, in few rounds of squares."""
    rng = np.random.default_rng(1)
    xy = [(c, 1000.0 * c + u, 50.0 * c * u + (1e-13 * (i % 3))) for c in range(3) for i, u in enumerate(np.repeat(rng.random(40), 3))]
    df = spark.createDataFrame([(i, c, float(x), float(y)) for i, (c, x, y) in enumerate(xy)], "cell_id long, cluster int, fx double, fy double")
    calls, keep = [], lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda d, *a: calls.append(d.columns) or keep(d, *a))
    got = {(r.src, r.dst) for r in lineage.nearest_links(df).collect()}
    best = {}
    for i, (c, x, y) in enumerate(xy):
        for j, (e, u, v) in enumerate(xy):
            if c != e:
                best[c] = min(best.get(c, (np.inf,)), (round((x - u) ** 2 + (y - v) ** 2, 9), i, j))
    assert got == {b[1:] for b in best.values()} and len(calls) <= 16


def test_tsne_sends_each_point_once(spark, monkeypatch):
    """A point's edges lie in one row, rows hold neighbouring points, and a step's sum over all pairs is known before it."""
    monkeypatch.setattr(embed, "EDGES", 64)
    y = np.random.default_rng(3).random((150, 2))
    points = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(y)], "id long, v array<double>")
    rows = embed._packed(embed.edges(points, 150, 4.0, None), np.arange(0, 750, 5), store.shared_folder(spark)).collect()
    seen = [np.unique(np.frombuffer(r.i, np.int32)) for r in rows]
    assert len(rows) >= 2 and sorted(np.concatenate(seen)) == list(range(150)) and all(np.array_equal(s, np.arange(s[0], s[-1] + 1)) for s in seen)
    grid = embed.Grid(y)
    assert np.isclose(grid.z, grid.push(y)[0], rtol=1e-9)


def test_line_search_looks_only_at_rows_that_go_on(monkeypatch):
    """Halved steps are tried for the rows that need them, not for the whole batch."""
    rng, looked, gradients = np.random.default_rng(0), [], factor.row_gradients
    size = rng.integers(0, 60, 2000)
    offs = np.concatenate([[0], np.cumsum(size)])
    idx, val = rng.integers(0, 1000, offs[-1]), rng.integers(1, 50, offs[-1]).astype(float)
    monkeypatch.setattr(factor, "row_gradients", lambda *a: looked.append(len(a[0])) or gradients(*a))
    w = factor.quasi_newton(idx, val, offs, rng.random((1000, 3)) * 3, rng.random((2000, 3)), 20)
    assert np.isfinite(w).all() and (w >= 0).all() and sum(looked) < 60 * offs[-1]


def test_nmf_reads_stored_entries(spark, monkeypatch):
    """Rounds don't sum the entries up again."""
    seen, kept = [], CountMatrix.kept
    monkeypatch.setattr(CountMatrix, "kept", lambda m: seen.append(kept(m)) or seen[-1])
    m = matrix(spark, np.random.default_rng(0).poisson(1.0, (6, 5)))
    assert np.isfinite(factor.nmf(m, 2, max_iters=5).cost) and len(seen) == 1
    assert "Aggregate" not in seen[0].entries._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in seen[0].entries.collect()} == {tuple(r) for r in m.entries.collect()}
