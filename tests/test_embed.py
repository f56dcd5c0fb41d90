"""t-SNE against the exact one, its forces against sums over all pairs, and landmark MDS against the classical one."""

import numpy as np
import pytest
from test_operators import matrix

from tallymix.operators import embed, neighbours, reduce


def tsne(distances: np.ndarray, d: int = 2, perplexity: float = 30.0, iterations: int = 300, seed: int = 0) -> np.ndarray:
    """Exact t-SNE of a distance matrix."""
    n = len(distances)
    square = distances**2
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            row = np.exp(-beta * (square[i] - np.delete(square[i], i).min(initial=0)))
            row[i] = 0
            total = row.sum() + 1e-300
            entropy = np.log(total) + beta * (row * (square[i] - np.delete(square[i], i).min(initial=0))).sum() / total
            if abs(entropy - np.log(min(perplexity, max(2, (n - 1) / 3)))) < 1e-4:
                break
            if entropy > np.log(min(perplexity, max(2, (n - 1) / 3))):
                lo, beta = beta, beta * 2 if np.isinf(hi) else (beta + hi) / 2
            else:
                hi, beta = beta, (beta + lo) / 2
        p[i] = row / total
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, step, gain = rng.normal(0, 1e-4, (n, d)), np.zeros((n, d)), np.ones((n, d))
    for it in range(iterations):
        num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), 1e-12)
        pull = (p * (12 if it < 100 else 1) - q) * num
        grad = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if it < 100 else 0.8) * step - 100 * gain * grad
        y = y + step
        y = y - y.mean(0)
    return y

def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """The share of the map's neighbours that are neighbours of the points, by how far off the others are."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    rank = np.argsort(np.argsort(d, axis=1), axis=1)
    e = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(e, np.inf)
    near = np.argsort(e, axis=1)[:, :k]
    off = np.maximum(np.take_along_axis(rank, near, 1) - k + 1, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * off


def groups(n: int, dims: int = 6) -> np.ndarray:
    rng = np.random.default_rng(2)
    return rng.normal(size=(8, dims))[rng.integers(0, 8, n)] * 4 + rng.normal(size=(n, dims))


def test_grid_pushes_like_all_pairs():
    y = np.random.default_rng(1).normal(size=(400, 2)) * 12
    z, force = embed.Grid(y).push(y)
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(-1))
    np.fill_diagonal(q, 0)
    want = ((q**2)[..., None] * diff).sum(1)
    assert z == pytest.approx(q.sum(), rel=2e-3)
    assert np.abs(force - want).max() < 0.02 * np.abs(want).max()


def test_affinities_have_the_perplexity():
    square = np.random.default_rng(5).random((20, 30)) * 7
    p = embed.affinities(square, 9.0)
    assert np.allclose(np.exp(-(p * np.log(p)).sum(1)), 9.0, rtol=1e-6) and np.allclose(p.sum(1), 1)
    assert np.isfinite(embed.affinities(np.array([[0.0, 0.0, np.inf], [1.0, np.inf, np.inf]]), 2.0)).all()


def test_map_is_as_trustworthy_as_the_exact_one(spark):
    x = groups(1000)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, w array<double>")
    got = np.array([r.x for r in embed.embed_tsne(df, iterations=200).orderBy("cell_id").collect()])
    exact = tsne(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)), iterations=200)
    assert trustworthiness(x, got) > trustworthiness(x, exact) - 0.01 > 0.85


def test_few_points_and_metrics(spark):
    w = np.random.default_rng(3).dirichlet([1.0] * 4, 12)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(w)], "cell_id long, w array<double>")
    for metric in ("euclidean", "kld", "jensen-shannon"):
        rows = embed.embed_tsne(df, metric, iterations=5).collect()
        assert len(rows) == 12 and np.isfinite([r.x for r in rows]).all()
    assert embed.embed_tsne(df.limit(1)).first().x == [0.0, 0.0]
    assert embed.embed_tsne(df.limit(0)).count() == 0


@pytest.mark.parametrize("metric", sorted(neighbours.TERMS))
def test_other_metrics_equal_brute_force(spark, metric):
    w = np.random.default_rng(7).dirichlet([0.5] * 5, 300)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(w)], "cell_id long, vec array<double>").repartition(3)
    d = neighbours.by_terms(metric, w, w)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbours.nearest(df, 3, metric=metric).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: list(np.lexsort((np.arange(300), d[i]))[:3]) for i in range(300)}


def poisson_distances(x: np.ndarray) -> np.ndarray:
    a, b = x.T[:, None], x.T[None]
    return ((a - b) * np.log((a + 1e-10) / (b + 1e-10))).sum(-1)


def test_landmarks_of_all_cells_are_classical(spark):
    x = np.random.default_rng(9).poisson(2, (7, 40)).astype(float)
    x[:, 5] = 0
    got = np.array([r.x for r in reduce.dim_reduce_data(matrix(spark, x), 2, 40).orderBy("cell_id").collect()])
    want = reduce.classical_mds(poisson_distances(x), 2)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6 * np.abs(want).max())


def test_landmarks_place_the_others(spark):
    """Cells of two kinds: with a quarter of them as landmarks the first axis agrees closely with the classical one."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.poisson(8, (12, 40)) * (np.arange(12) < 6)[:, None] + 1, rng.poisson(8, (12, 40)) * (np.arange(12) >= 6)[:, None] + 1], 1).astype(float)
    got = np.array([r.x for r in reduce.dim_reduce_data(matrix(spark, x), 1, 20).orderBy("cell_id").collect()])[:, 0]
    want = reduce.classical_mds(poisson_distances(x), 1)[:, 0]
    assert abs(np.corrcoef(got, want)[0, 1]) > 0.98
