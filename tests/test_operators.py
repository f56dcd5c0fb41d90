"""Recovery, invariants and round trips of the operators that SQL can't check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymix.functions import special, vectors
from tallymix.operators import cluster, dispersed, evaluate, experiment, factor, lda, lineage, prep, prior, reduce, simulate
from tallymix.operators.matrix import CountMatrix, unpacked
from tallymix.sources import text
from tallymix.streaming import scoring

CENTERS = np.array([[2, 14, 31], [3, 17, 2], [60, 4, 90]], float)


@pytest.fixture(scope="module")
def sim(spark):
    m, labels = simulate.poisson_data(spark, CENTERS, 240, seed=3)
    return CountMatrix(m.entries.persist(), m.genes, m.cells), labels.persist()


def matrix(spark, x):
    x = np.asarray(x, float)
    rows = [(int(g), int(c), float(x[g, c])) for g, c in zip(*np.nonzero(x), strict=True)]
    ids = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    return CountMatrix.of(spark.createDataFrame(rows, "gene_id long, cell_id long, value double"), ids(len(x), "gene_id"), ids(x.shape[1], "cell_id"))


def purity_of(labels, true):
    return evaluate.purity(evaluate.contingency(labels, true)).first()[0]


def test_poisson_cluster_recovers(sim):
    m, true = sim
    labels, centers = max((cluster.poisson_cluster(m, 3, seed=s) for s in (1, 2, 3)), key=lambda x: purity_of(x[0], true))  # each run ends in some optimum
    assert purity_of(labels, true) > 0.9
    assert not centers.where("m is null or isnan(m)").count()


def test_kmeans_pp_centers_differ(sim):
    centers, _ = cluster.kmeans_pp(sim[0], 3, seed=2)
    rows = {tuple(r.m) for r in centers.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("gene_id", "m")))["m"].alias("m")).collect()}
    assert len(rows) == 3


def test_sweep_equals_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(2.0, (6, 5))
    x[:, 2] = 0
    m = matrix(spark, x)
    mm, ww = rng.random((6, 3)) + 0.5, rng.random((5, 3)) + 0.1
    means = spark.createDataFrame([(g, [float(v) for v in mm[g]]) for g in range(6)], "gene_id long, m array<double>")
    weights = spark.createDataFrame([(c, [float(v) for v in ww[c]]) for c in range(5)], "cell_id long, w array<double>")
    got = {r.cell_id: r.w for r in factor.sweep(m, means, weights, 3, 0.5).collect()}
    idx = np.concatenate([np.flatnonzero(x[:, c]) for c in range(5)])
    val = np.concatenate([x[np.flatnonzero(x[:, c]), c] for c in range(5)]).astype(float)
    offs = np.concatenate([[0], np.cumsum((x > 0).sum(0))])
    want = factor.sweeps(idx, val, offs, mm, ww, 1, 0.5)
    assert np.allclose([got[c] for c in range(5)], want, atol=1e-9)
    for c in range(5):
        pull = sum(x[g, c] * mm[g] / (mm[g] @ ww[c] + 1e-10) for g in range(6))
        d = 1 + ww[c] / (2 * x[:, c].sum() + 1e-8) * (0.5 + mm.sum(0) - pull)
        assert np.allclose(want[c], np.where(d > 0, ww[c] / d, 0))


def test_state_estimation_recovers(spark):
    means = np.array([[20, 30], [10, 3], [90, 50], [10, 4]], float)
    w1 = np.tile([0.1, 0.2, 0.3, 0.4, 0.5, 0.8, 0.9], 20)
    m = simulate.state_data(spark, means, np.stack([w1, 1 - w1]), seed=1)
    e = factor.poisson_estimate_state(m, 2, max_iters=6, inner_max_iters=40, initialization="cluster", seed=1)
    assert np.allclose(e.w.sum(1), 1)
    first = factor.poisson_estimate_state(m, 2, max_iters=1, inner_max_iters=1, initialization="cluster", seed=1, normalize=False).cost
    last = factor.poisson_estimate_state(m, 2, max_iters=6, inner_max_iters=40, initialization="cluster", seed=1, normalize=False).cost
    assert last <= first + 1e-9
    assert max(abs(np.corrcoef(e.w[:, j], w1)[0, 1]) for j in (0, 1)) > 0.5


def test_large_factors_give_the_same(spark, sim, monkeypatch):
    rng = np.random.default_rng(7)
    m = matrix(spark, rng.poisson(1.5, (9, 40)))
    start = m.cells.select("cell_id", (F.col("cell_id") % 2).cast("int").alias("cluster"))
    for masked in (False, True):
        options = {"init_weights": start, "max_iters": 2, "inner_max_iters": 2, "masked": masked, "normalize": False, "constrain_w": True}
        small = factor.poisson_estimate_state(m, 2, **options)
        full = factor.update_m(m, small, 2)
        monkeypatch.setattr(factor, "FACTOR_BYTES", 100)
        large = factor.poisson_estimate_state(m, 2, **options)
        assert np.allclose(small.w, large.w, atol=1e-9) and np.allclose(small.m, large.m, atol=1e-9) and small.cost == pytest.approx(large.cost, abs=1e-9)
        assert np.allclose(factor.update_m(m, small, 2).m, full.m, atol=1e-9)
        monkeypatch.setattr(factor, "FACTOR_BYTES", 256 << 20)


def test_quasi_newton_reaches_the_optimum():
    rng = np.random.default_rng(8)
    m, true = rng.random((30, 3)) * 5, rng.dirichlet(np.ones(3), 12)
    x = rng.poisson(m @ true.T)
    idx = np.concatenate([np.flatnonzero(x[:, c]) for c in range(12)])
    val = np.concatenate([x[np.flatnonzero(x[:, c]), c] for c in range(12)]).astype(float)
    offs = np.concatenate([[0], np.cumsum((x > 0).sum(0))])
    start = np.full((12, 3), 1 / 3)
    cost = lambda w: (m @ w.T - x * np.log(m @ w.T + 1e-10)).sum(0)
    got, slow = factor.quasi_newton(idx, val, offs, m, start, 100), factor.sweeps(idx, val, offs, m, start, 20000)
    assert (got >= 0).all() and (cost(got) <= cost(slow) + 1e-4).all()


def test_lbfgs_method(spark, sim):
    m = sim[0]
    e = factor.poisson_estimate_state(m, 3, max_iters=2, inner_max_iters=20, initialization="kmpp", method="L-BFGS-B")
    assert np.isfinite(e.cost) and np.allclose(e.w.sum(1), 1)
    with pytest.raises(ValueError):
        factor.poisson_estimate_state(m, 3, method="L-BFGS-B", masked=True)


def test_topics_beyond_the_driver_keep_their_weights(sim, monkeypatch):
    e = lda.lda_estimate_state(sim[0], 3, max_iters=5)
    assert np.allclose(e.w.sum(1), 1) and e.w.shape == (240, 3)


def test_starts(sim):
    m, true = sim
    labels = true.select("cell_id", F.col("label").alias("cluster"))
    for kind in ("basic", "enhanced", "nmf"):
        means, weights = factor.nmf_start(m, labels, 3, kind)
        top = {r.cell_id: int(np.argmax(r.w)) for r in weights.collect()}
        assert means.count() == 3 and np.mean([top[r.cell_id] == r.label for r in true.collect()]) > 0.7
    w = factor.nearest_weights(m, cluster.cluster_means(m, labels, 3), 3).collect()
    assert np.mean([int(np.argmax(r.w)) for r in sorted(w, key=lambda r: r.cell_id)] == np.array([r.label for r in true.orderBy("cell_id").collect()])) > 0.9


def test_pca_is_centred(spark):
    x = np.random.default_rng(6).poisson(3, (6, 30)).astype(float)
    got = np.array([r.vec for r in factor.truncated_svd(matrix(spark, x), 2, passes=60, centred=True)[0].orderBy("cell_id").collect()])
    c = x - x.mean(1, keepdims=True)
    assert np.allclose(np.linalg.norm(got, axis=0), np.linalg.svd(c)[1][:2], rtol=1e-6) and np.allclose(got.mean(0), 0, atol=1e-9)


def test_update_m_keeps_weights(spark, sim):
    m = sim[0]
    part = m.select_genes(m.genes.where("gene_id < 2"))
    e = factor.poisson_estimate_state(part, 3, max_iters=2, inner_max_iters=10, initialization="kmpp")
    full = factor.update_m(m, e, 10)
    assert full.m.shape == (3, 3) and np.isfinite(full.m).all() and np.array_equal(full.w, e.w)


def test_nmf_cost_is_frobenius(spark):
    x = np.random.default_rng(4).poisson(3, (5, 8))
    m = matrix(spark, x)
    e = factor.nmf(m, 2, max_iters=40, normalize_w=False)
    assert math.isclose(e.cost, 0.5 * ((x - e.m @ e.w.T) ** 2).sum(), rel_tol=1e-9)


def test_svd_scores(spark):
    x = np.random.default_rng(5).poisson(3, (6, 12)).astype(float)
    scores, _, values = factor.truncated_svd(matrix(spark, x), 2, passes=40)
    assert np.allclose(values, np.linalg.svd(x)[1][:2], rtol=1e-6)
    got = np.array([r.vec for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(np.linalg.norm(got, axis=0)), values, rtol=1e-6)


def test_packing_round_trip(sim):
    m = sim[0]
    assert sorted(map(tuple, unpacked(m.packed_cells()).select("gene_id", "cell_id", "value").collect())) == sorted(map(tuple, m.entries.select("gene_id", "cell_id", "value").collect()))
    assert m.T.T.entries.exceptAll(m.entries).isEmpty()


def test_empty_cells_count(spark):
    m = matrix(spark, [[2, 0, 0], [0, 4, 0]])
    stats = {r.gene_id: (r.mean, r["var"]) for r in prep.gene_mean_var(m).collect()}
    assert stats[0] == pytest.approx((2 / 3, np.var([2, 0, 0]))) and stats[1] == pytest.approx((4 / 3, np.var([0, 4, 0])))
    assert [r.total for r in prep.cell_totals(m).orderBy("cell_id").collect()] == [2, 4, 0]
    assert {(r.gene_id, r.cell_id): r.value for r in prep.cell_normalize(m).entries.collect()} == {(0, 0): 2.0, (1, 1): 2.0}


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 33.0, 700.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(special.lgamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], atol=1e-9)
    assert np.allclose(special.lgamma_np(np.array(xs)), [math.lgamma(x) for x in xs], atol=1e-9)
    slope = [(math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5 for x in xs]
    assert np.allclose([r[0] for r in df.select(special.digamma(F.col("x"))).collect()], slope, rtol=1e-5)
    assert np.allclose(special.digamma_np(np.array(xs)), slope, rtol=1e-5)
    z = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], "x double")
    want = [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)]
    assert np.allclose([r[0] for r in z.select(special.normal_cdf(F.col("x"))).collect()], want, atol=2e-7)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0, 3.0])], "p array<double>, q array<double>")
    r = df.select(vectors.poisson_dist(F.col("p"), F.col("p")), vectors.poisson_dist(F.col("p"), F.col("q")), vectors.poisson_dist(F.col("q"), F.col("p"))).first()
    assert r[0] == 0 and r[1] == pytest.approx(math.log(2), abs=1e-6) and r[1] == pytest.approx(r[2])


def test_nb_and_zip_fits(spark):
    p, r = np.array([[0.5], [0.3]]), np.array([[2.0], [8.0]])
    m, _ = simulate.nb_data(spark, p, r, 3000, seed=2)
    got = {x.gene_id: (x.p, x.r) for x in dispersed.nb_fit(m).collect()}
    for g in (0, 1):
        assert got[g][0] == pytest.approx(p[g, 0], abs=0.1) and got[g][1] == pytest.approx(r[g, 0], rel=0.4)
    m, _ = simulate.zip_data(spark, np.array([[5.0], [2.0]]), np.array([[0.3], [0.6]]), 3000, seed=2)
    got = {x.gene_id: (x.lam, x.pi) for x in dispersed.zip_fit(m).collect()}
    assert got[0] == pytest.approx((5, 0.3), abs=0.2) and got[1] == pytest.approx((2, 0.6), abs=0.2)


def two_means(values: np.ndarray, gaussian: bool = False) -> tuple[float, float, np.ndarray]:
    """(low, high, assignment to high) of one gene's values in two groups: the best cut of the sorted values.

    In one dimension the optimum of Poisson (or squared-error) 2-means is a cut,
    so all cuts are tried by prefix sums, the first of the best (to 9 places) is
    taken.  low and high are the groups' medians.
    """
    order = np.argsort(values, kind="stable")
    x = values[order]
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return (float(np.median(x)),) * 2 + (np.zeros(n, bool),) if n else (0.0, 0.0, np.zeros(0, bool))
    sums, k = np.cumsum(x)[:-1], np.arange(1, n)
    left, right = sums / k, (x.sum() - sums) / (n - k)
    if gaussian:
        gain = sums * left + (x.sum() - sums) * right
    else:
        logs = lambda s, mean: s * np.log(mean + 1e-10)
        gain = logs(sums, left) + logs(x.sum() - sums, right)
    gain[x[1:] == x[:-1]] = -np.inf
    cut = int(np.argmax(np.round(gain, 9))) + 1
    high = np.zeros(n, bool)
    high[order[cut:]] = True
    return float(np.median(x[:cut])), float(np.median(x[cut:])), high


def test_two_means_finds_best_cut():
    x = np.array([1, 30, 0, 2, 28, 31], float)
    low, high, up = two_means(x)
    assert (low, high) == (1, 30) and up.tolist() == [False, True, False, False, True, True]
    assert two_means(np.array([3.0, 3.0]))[:2] == (3.0, 3.0)


def test_qual_norm_fills_missing(spark, sim):
    m, _ = sim
    rows = [(g, k, -1.0 if g == 1 else float(CENTERS[g, k])) for g in range(3) for k in range(3)]
    out = prior.qual_norm(m, spark.createDataFrame(rows, "gene_id long, k int, q double")).collect()
    assert len(out) == 9 and all(math.isfinite(r.m) for r in out)


def test_mds_is_projection(spark):
    means = [[20, 30, 1], [10, 3, 8], [90, 50, 20], [10, 4, 30]]
    df = spark.createDataFrame([(g, k, float(means[g][k])) for g in range(4) for k in range(3)], "gene_id long, k int, m double")
    x = {r.k: r.x for r in reduce.dim_reduce(df).collect()}
    w = spark.createDataFrame([(0, [0.2, 0.3, 0.5])], "cell_id long, w array<double>")
    got = reduce.mds(df, w).first().x
    assert np.allclose(got, sum(p * np.array(x[k]) for k, p in enumerate([0.2, 0.3, 0.5])), atol=1e-6)


def test_lineage_and_pseudotime(spark):
    means, weights = simulate.poisson_lineage(3, 25, 30, seed=1)
    mdf = spark.createDataFrame([(g, k, float(means[g, k])) for g in range(30) for k in range(3)], "gene_id long, k int, m double")
    wdf = spark.createDataFrame([(c, [float(v) for v in weights[:, c]]) for c in range(75)], "cell_id long, w array<double>")
    points, edges = lineage.run_lineage(mdf, wdf)
    near = sum(abs(r.src - r.dst) <= 2 for r in edges.collect())
    assert near > 40
    time = {r.cell_id: r.time for r in lineage.pseudotime(0, edges, points).collect()}
    assert time[0] == 0 and len(time) == 75


def test_graph_without_path(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (8, 9, 1.0)], "src long, dst long, d double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9)], "cell_id long")
    assert {r.cell_id: r.distance for r in lineage.graph_distances(1, edges, nodes).collect()} == {1: 0.0, 2: 1.0, 3: 3.0, 8: None, 9: None}


def test_contracted_paths_equal_plain(spark, monkeypatch):
    rng = np.random.default_rng(10)
    pairs = [(i, i + 1) for i in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(10, 105), (40, 120), (60, 3), (200, 201)] + [(30, 300 + i) for i in range(5)]
    rows = [(a, b, float(rng.integers(1, 9))) for a, b in pairs] + [(5, 6, 0.5), (5, 5, 1.0)]
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    best = {n: math.inf for n in nodes} | {0: 0.0}
    for _ in nodes:
        for a, b, d in rows:
            best[b], best[a] = min(best[b], best[a] + d), min(best[a], best[b] + d)
    edges, cells = spark.createDataFrame(rows, "src long, dst long, d double"), spark.createDataFrame([(n,) for n in nodes], "cell_id long")
    want = {n: None if math.isinf(d) else d for n, d in best.items()}
    assert {r.cell_id: r.distance for r in lineage.graph_distances(0, edges, cells).collect()} == want
    monkeypatch.setattr(lineage, "CORE_EDGES", 6)
    assert {r.cell_id: r.distance for r in lineage.graph_distances(0, edges, cells).collect()} == want


def test_nearest_links_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(i % 4), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (80, 2)) + np.repeat([[0, 0], [9, 0], [0, 9], [200, 200]], 20, 0)[np.argsort(np.arange(80) % 4, kind="stable").argsort()])]
    want = {min((round((x - u) ** 2 + (y - v) ** 2, 9), i, j) for i, c, x, y in rows if c == k for j, e, u, v in rows if e != k)[1:] for k in range(4)}
    got = lineage.nearest_links(spark.createDataFrame(rows, "cell_id long, cluster int, fx double, fy double"))
    assert {tuple(r) for r in got.collect()} == want
    one = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 1.0, 1.0)], "cell_id long, cluster int, fx double, fy double")
    assert lineage.nearest_links(one).count() == 0 and lineage.nearest_links(one.where("false")).count() == 0


def test_one_far_cell_does_not_widen_the_squares(spark):
    """Two clusters of 20 000 cells that nearly touch and one cell far out; without small squares all would pair with all."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.random((20_000, 2)), rng.random((20_000, 2)) + [1.0005, 0], [[1e9, 1e9]]])
    rows = [(i, min(i // 20_000, 2), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = dict(map(tuple, lineage.nearest_links(spark.createDataFrame(rows, "cell_id long, cluster int, fx double, fy double").repartition(4)).collect()))
    a, b = xy[:20_000], xy[20_000:40_000]
    edge_a, edge_b = np.argsort(-a[:, 0])[:1500], np.argsort(b[:, 0])[:1500]
    d = ((a[edge_a][:, None] - b[edge_b][None]) ** 2).sum(-1)
    i, j = divmod(int(d.argmin()), 1500)
    assert got[int(edge_a[i])] == int(edge_b[j]) + 20_000 and got[int(edge_b[j]) + 20_000] == int(edge_a[i])
    assert 40_000 in got and len(got) == 3


def test_text_round_trips(spark, sim, tmp_path):
    m = sim[0]
    text.write_matrix_market(m, str(tmp_path / "m"))
    parts = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-"))
    (tmp_path / "m.mtx").write_text("".join(p.read_text() for p in parts))
    back = text.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, m.entries.collect()))
    text.write_lines(text.word_lines(m), str(tmp_path / "w"))
    assert sorted(map(tuple, text.read_word_counts(spark, str(tmp_path / "w")).collect())) == sorted(map(tuple, m.entries.collect()))
    (tmp_path / "d.txt").write_text("1 0 2\n0 3 0\n")
    assert sorted(map(tuple, text.read_dense(spark, str(tmp_path / "d.txt")).entries.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)]
    (tmp_path / "t.txt").write_text("0 0:1.5 2:3\n1 1:2\n")
    assert len(text.read_topic_lines(spark, str(tmp_path / "t.txt")).collect()) == 3
    (tmp_path / "g.txt").write_text("G0 1 2\nG1 3 4\n")
    assert {(r.gene_id, r.k): r.value for r in text.read_word_topics(spark, str(tmp_path / "g.txt")).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_downsample_and_hold_out(sim):
    m, _ = sim
    before, after = (x.entries.agg(F.sum("value")).first()[0] for x in (m, simulate.downsample(m, 0.25, seed=1)))
    assert after == pytest.approx(0.75 * before, rel=0.05)
    rest, out = simulate.hold_out(m, 0.2, seed=1)
    assert rest.entries.count() + out.count() == m.entries.count() and out.count() > 0


def test_dbscan(spark):
    pts = [(i, [0.1 * i, 0.0]) for i in range(6)] + [(10 + i, [5 + 0.1 * i, 5.0]) for i in range(6)] + [(99, [50.0, 50.0])]
    got = {r.cell_id: r.cluster for r in cluster.dbscan(spark.createDataFrame(pts, "cell_id long, vec array<double>"), 0.3, 3).collect()}
    assert got[99] == -1 and len({got[i] for i in range(6)}) == 1 and len({got[10 + i] for i in range(6)}) == 1 and got[0] != got[10]


def test_streamed_scores(spark, sim, tmp_path):
    m, _ = sim
    packed = m.packed_cells()
    packed.write.parquet(str(tmp_path / "in"))
    q = scoring.start_scoring(spark.readStream.schema(packed.schema).parquet(str(tmp_path / "in")), np.arange(3), CENTERS, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = {r.cell_id: r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.cell_id: r.w for r in scoring.score_cells(packed, np.arange(3), CENTERS).collect()}
    assert got == want and all(abs(sum(w) - 1) < 1e-9 for w in got.values())


def test_metrics_edges(spark):
    one = spark.createDataFrame([(0, 0, 5)], "cluster int, label int, n long")
    assert evaluate.nmi(one).first()[0] == 1 and evaluate.ari(one).first()[0] == 1 and evaluate.purity(one).first()[0] == 1


def test_biclusters_recover(sim):
    m, true = sim
    cells, genes = cluster.cocluster(m, 3)
    assert cells.count() == 240 and genes.count() == 3 and purity_of(cells, true) > 0.6
    assert purity_of(cluster.bicluster(m, 3, 2)[0], true) > 0.6


def test_objective_gradient():
    rng = np.random.default_rng(1)
    x, m, w = rng.poisson(3, (5, 2)).astype(float), rng.random((5, 2)) + 0.5, rng.random((2, 2)) + 0.5
    value, grad = factor.objective_gradient(x, m, w)
    step = np.zeros_like(w)
    step[1, 0] = 1e-6
    assert (factor.objective_gradient(x, m, w + step)[0] - value) / 1e-6 == pytest.approx(grad[1, 0], abs=1e-4)


def test_zip_row_ll():
    assert dispersed.zip_row_ll(2.0, 0.3, np.array([1.0, 3.0]), 4) == pytest.approx(sum(math.log(0.7 * math.exp(-2) * 2**k / math.factorial(k)) for k in (1, 3)) + 4 * math.log(0.3 + 0.7 * math.exp(-2)), abs=1e-6)


@pytest.mark.parametrize("gaussian", [False, True])
def test_levels_by_runs_equal_the_best_cut(spark, gaussian):
    """Prefix sums over runs against sorted dense values: few and many values, one value, only zeros, ties of the gain."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.poisson(3, 60), rng.poisson(40, 60) * (rng.random(60) < 0.4), np.full(60, 2), np.zeros(60), np.arange(60) % 2, rng.random(60) * 9]).astype(float)
    m = matrix(spark, x)
    got = {r.gene_id: r for r in prior.gene_levels(m, m.genes, gaussian).collect()}
    for g in range(len(x)):
        low, high, up = two_means(x[g], gaussian)
        if gaussian:
            low, high = x[g][~up].mean(), x[g][up].mean() if up.any() else x[g].mean()
        assert (got[g].low, got[g].high) == pytest.approx((low, high))


def plain_nb(x: np.ndarray) -> float:
    """ln r where the likelihood's slope over all cells changes its sign, by halving."""
    mean, var = x.mean(), x.var()
    start = np.log(max(mean**2 / (var - mean), 1e-6))
    lo, hi = start - 6, start + 6
    for _ in range(60):
        mid = (lo + hi) / 2
        r = np.exp(mid)
        slope = sum((1 / (r + np.arange(int(v)))).sum() for v in x) + len(x) * np.log(r / (r + mean))
        lo, hi = (mid, hi) if slope > 0 else (lo, mid)
    return (lo + hi) / 2


def test_nb_fit_is_at_the_plain_solution(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.negative_binomial(2, 0.3, 200), rng.negative_binomial(30, 0.7, 200), rng.poisson(2, 200) * (rng.random(200) < 0.1), np.zeros(200), np.full(200, 3)]).astype(float)
    got = {r.gene_id: r for r in dispersed.nb_fit(matrix(spark, x)).collect()}
    assert len(got) == 5 and got[3].r is None and got[4].r is None
    for g in range(3):
        assert x[g].var() > x[g].mean() and math.log(got[g].r) == pytest.approx(plain_nb(x[g]), abs=1e-6)
        assert got[g].p == pytest.approx(x[g].mean() / (got[g].r + x[g].mean()))


def test_hot_gene_is_a_table_of_its_values(spark):
    """Two million entries of one gene: the fit and the levels see some hundred (value, number) rows."""
    n = 2_000_000
    entries = spark.range(n).select(F.lit(0).alias("gene_id"), F.col("id").alias("cell_id"), (F.pmod(F.xxhash64("id"), F.lit(9)) * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9))).cast("double").alias("value"))
    m = CountMatrix(entries.where("value > 0"), spark.range(1).withColumnRenamed("id", "gene_id"), spark.range(n).withColumnRenamed("id", "cell_id"))
    assert dispersed.nb_fit(m).first().r > 0
    levels = prior.gene_levels(m, m.genes).first()
    assert 0 <= levels.low < levels.high


def test_trigamma():
    x = np.array([0.05, 1.0, 3.5, 40.0])
    h = 1e-5
    assert np.allclose(special.trigamma_np(x), (special.digamma_np(x + h) - special.digamma_np(x - h)) / (2 * h), rtol=1e-5)
    assert special.trigamma_np(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)


def test_consensus_of_noisy_runs(spark):
    """Runs with other names and a fifth of the cells wrong: the consensus is the truth but for names, and empty runs give nothing."""
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 4, 300)
    rows = []
    for run in range(9):
        name, seen = rng.permutation(4), np.where(rng.random(300) < 0.2, rng.integers(0, 4, 300), truth)
        rows += [(run, c, int(name[seen[c]])) for c in range(300)]
    df = spark.createDataFrame(rows, "run int, cell_id long, cluster int")
    got = {r.cell_id: r.cluster for r in cluster.consensus(df, 4).collect()}
    named = [np.bincount([got[c] for c in range(300) if truth[c] == t], minlength=4) for t in range(4)]
    assert len(got) == 300 and len({int(n.argmax()) for n in named}) == 4 and sum(n.max() for n in named) >= 295
    assert cluster.consensus(df.limit(0), 4).count() == 0


def test_linkages_by_hand():
    likeness = np.array([[1, 0.9, 0.5, 0.0], [0.9, 1, 0.0, 0.0], [0.5, 0.0, 1, 0.3], [0.0, 0.0, 0.3, 1]])
    assert cluster.linked_groups(likeness, 2, "mean").tolist() == [0, 0, 1, 1]  # 0-1, then 2-3 (0.3) before 01-2 (0.25)
    assert cluster.linked_groups(likeness, 2, "greatest").tolist() == [0, 0, 0, 1]
    assert cluster.linked_groups(likeness, 2, "least").tolist() == [0, 0, 1, 1]
    assert cluster.linked_groups(likeness, 9, "mean").tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("centred", [False, True])
def test_svd_with_both_sides_as_tables(spark, monkeypatch, centred):
    """The same singular values and spaces with FACTOR_BYTES at 1 KB."""
    x = np.random.default_rng(5).poisson(3, (40, 60)).astype(float) + 5 * np.outer(np.arange(40) % 3, np.arange(60) % 4)
    monkeypatch.setattr(factor, "FACTOR_BYTES", 1 << 10)
    scores, right, values = factor.truncated_svd(matrix(spark, x), 4, passes=8, centred=centred)
    u, s, vt = np.linalg.svd(x - x.mean(1, keepdims=True) * centred)
    got = np.array([r.vec for r in scores.orderBy("cell_id").collect()])
    genes = np.array([r.vec for r in right.orderBy("gene_id").collect()])
    assert np.isclose(values[0], s[0], rtol=1e-6) and np.isclose(values[1], s[1], rtol=1e-2) and np.allclose(genes.T @ genes, np.eye(4), atol=1e-9)
    assert np.allclose(np.abs(got[:, 0]), np.abs(vt[0] * s[0]), atol=1e-3 * s[0]) and np.allclose(np.abs(genes[:, 0]), np.abs(u[:, 0]), atol=1e-3)


def test_orthonormal_of_dependent_columns(spark):
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    from tallymix.operators import tall

    x = np.random.default_rng(1).normal(size=(30, 3))
    x[:, 2] = x[:, 0] + x[:, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], StructType([StructField("gene_id", LongType()), StructField("vec", ArrayType(DoubleType()))]))
    q = np.array([r.vec for r in tall.orthonormal(df, "gene_id", 3).orderBy("gene_id").collect()])
    e = np.linalg.eigvalsh(q.T @ q)
    assert np.allclose(e, [0, 1, 1], atol=1e-9)


def test_states_as_points_and_places(sim):
    m, _ = sim
    options = {"max_iters": 2, "inner_max_iters": 5, "initialization": "kmpp"}
    states = experiment.means_step(**options).run(m, 3).orderBy("cell_id").collect()
    assert [r.cell_id for r in states] == [0, 1, 2] and all(len(r.vec) == 3 for r in states)
    places = experiment.mds_step(2, **options).run(m, 3).collect()
    assert len(places) == 240 and all(len(r.vec) == 2 and np.isfinite(r.vec).all() for r in places)


def test_weights_as_tables_give_the_same_cells(spark):
    """Arrays and tables of weights, whatever the partitions; lineages and even weights made where they are used."""
    means, weights = simulate.poisson_lineage(3, 7, 5, seed=2)
    rows = lambda m: sorted(map(tuple, m.entries.collect()))
    made = simulate.lineage_weights(spark, 3, 7)
    assert np.allclose(np.array([r.w for r in made.orderBy("cell_id").collect()]).T, weights)
    table = spark.createDataFrame([(c, [float(v) for v in weights[:, c]]) for c in range(21)], "cell_id long, w array<double>")
    assert rows(simulate.state_data(spark, means, weights, 3)) == rows(simulate.state_data(spark, means, table.repartition(4), 3))
    even = np.array([r.w for r in simulate.even_weights(spark.range(4000).withColumnRenamed("id", "cell_id"), 3, 1).collect()])
    assert np.allclose(even.sum(1), 1) and np.allclose(even.mean(0), 1 / 3, atol=0.02) and np.allclose(even.var(0), 1 / 18, atol=0.006)
    with pytest.raises(ValueError):
        simulate.state_data(spark, means, np.zeros((3, simulate.WEIGHT_BYTES // 24 + 1)))
