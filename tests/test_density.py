"""DBSCAN against its definition, components against union-find, and a square of many points."""

import numpy as np
import pytest

from tallymix.operators import components, density


def plain_dbscan(x: np.ndarray, eps: float, least: int) -> list[int]:
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
        if np.array_equal(new, label):
            break
        label = new
    touched = np.where(near & core[None], label[None], len(x)).min(1)
    return [int(v) if v < len(x) else -1 for v in np.where(core, label, touched)]


RNG = np.random.default_rng(2)
SHAPES = {
    "plane": (RNG.random((500, 2)), 0.05, 5),
    "rings": (np.stack([np.cos(np.arange(400) / 20), np.sin(np.arange(400) / 20)], 1) * (1 + (np.arange(400) % 2))[:, None] + RNG.normal(0, 0.02, (400, 2)), 0.2, 4),
    "copies and dense squares": (np.concatenate([np.zeros((300, 2)), RNG.normal(0, 0.01, (400, 2)) + 1, RNG.random((100, 2)) * 2]), 0.1, 10),
    "line": (RNG.random((200, 1)) * 20, 0.2, 3),
    "five dimensions": (RNG.normal(size=(300, 5)) * 0.5, 0.6, 4),
    "all noise": (np.arange(20.0)[:, None] * 10, 1.0, 2),
}


@pytest.mark.parametrize("name", SHAPES)
def test_dbscan_equals_plain(spark, monkeypatch, name):
    monkeypatch.setattr(density, "BLOCK_ROWS", 40)
    x, eps, least = SHAPES[name]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "cell_id long, vec array<double>").repartition(3)
    got = {r.cell_id: r.cluster for r in density.dbscan(df, eps, least).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, eps, least)


def test_a_square_of_many_points(spark):
    """Two squares of 60 000 points each, side by side, and points without a place: no pair inside a square is made."""
    from pyspark.sql import functions as F

    df = spark.range(120_000).select(F.col("id").alias("cell_id"), F.array(F.rand(1) * 0.1 + (F.col("id") % 2) * 0.12, F.rand(2) * 0.1).alias("vec")).union(spark.createDataFrame([(200_000, None), (200_001, [5.0, 5.0])], "cell_id long, vec array<double>"))
    rows = {r.cluster: r["count"] for r in density.dbscan(df, 0.2, 5).groupBy("cluster").count().collect()}
    assert rows == {0: 120_000, -1: 2}


def test_any_within_equals_all_pairs():
    rng = np.random.default_rng(4)
    for gap in (0.0, 0.9, 1.0, 1.5):
        a, b = rng.random((500, 2)), rng.random((700, 2)) + [1 + gap, 0]
        for eps in (0.05, 0.95, 1.0, 1.6):
            assert density.any_within(a, b, eps) == bool((((a[:, None] - b[None]) ** 2).sum(-1) <= eps * eps).any())


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(6)
    links = [(int(u), int(v)) for u, v in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {n: n for link in links for n in link}
    for _ in range(len(root)):
        changed = False
        for u, v in links:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
        if not changed:
            break
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: c for n, c in root.items() if n in got} and all(c == n for n, c in root.items() if n not in got)
