"""Queries do their operators' whole jobs: the rounds, stages and steps that these have by default."""

import numpy as np
import pytest
from conftest import duck
from test_embed import groups
from test_expansion import _dense

from tallymix.operators import cluster, dispersed, embed
from tallymix.plans import catalog


def test_nb_state_estimation_takes_all_its_rounds(spark, sf, monkeypatch):
    """The SQL's weights are those of ten rounds of forty dense updates, and the query asks for no fewer."""
    c, seen = duck(sf), []
    got = c.execute(catalog.oracle_sql()["nb_state_estimation"]).df().sort_values(["cell_id", "k"]).value.to_numpy().reshape(-1, 3)
    genes, cells = c.execute("SELECT p_partkey FROM part ORDER BY 1").df().p_partkey.to_numpy(), c.execute("SELECT s_suppkey FROM supplier ORDER BY 1").df().s_suppkey.to_numpy()
    rows = c.execute("SELECT l_partkey AS g, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2").df()
    x = np.zeros((len(genes), len(cells)))
    x[np.searchsorted(genes, rows.g), np.searchsorted(cells, rows.c)] = rows.v
    means = np.stack([x[:, cells % 3 == k].mean(1) for k in range(3)], 1) + 1e-8
    weights = np.where(cells[:, None] % 3 == np.arange(3), 0.75, 0.125)
    want = _dense(x, 1.0 + genes % 5, means, weights, 10, 40)[1]
    assert np.abs(got - want).max() < 2e-6 < np.abs(_dense(x, 1.0 + genes % 5, means, weights, 10, 39)[1] - want).max()
    monkeypatch.setattr(dispersed, "nb_estimate_state", lambda m, k, r=None, max_iters=10, inner_max_iters=40, **options: seen.append((max_iters, inner_max_iters)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.queries()["nb_state_estimation"](spark, sf)
    assert seen == [(10, 40)]


def test_coarse_scan_leads_the_fine_one(spark, sf, monkeypatch):
    """The fine scan looks around the coarse one's choice, wherever that is; no k is looked at twice, none out of bounds."""
    monkeypatch.setattr(cluster, "reduced", lambda m, seed: None)
    for k_min, k_max, skip in ((1, 7, 3), (1, 50, 5), (2, 9, 4)):
        for peak in range(k_min, k_max + 1):
            seen = []
            monkeypatch.setattr(cluster, "gap", lambda scores, k, n, seed, peak=peak, seen=seen: seen.append(k) or (-abs(k - peak), 0.01))
            assert cluster.select_k(None, k_min, k_max, 2, skip) == peak
            assert len(seen) == len(set(seen)) and k_min <= min(seen) and max(seen) <= k_max
    asked = []
    monkeypatch.setattr(cluster, "select_k", lambda m, *a, **b: asked.append((a, b)) or 1)
    catalog.queries()["select_k"](spark, sf)
    assert asked == [((), {})]


def test_gap_is_that_of_sets_one_by_one(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 2)) + 9 * (np.arange(60) % 3)[:, None]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    at_once = [cluster.gap(df, k, 3) for k in (1, 3)]
    monkeypatch.setattr(cluster, "AT_ONCE", 1)
    assert at_once == [cluster.gap(df, k, 3) for k in (1, 3)]


def _divergence(x: np.ndarray, y: np.ndarray, perplexity: float) -> float:
    """What t-SNE makes small."""
    square = lambda a: ((a[:, None] - a[None]) ** 2).sum(-1) + np.diag(np.full(len(a), np.inf))
    p, q = embed.affinities(square(x), perplexity), 1 / (1 + square(y))
    p, q = (p + p.T) / (2 * len(x)), q / q.sum()
    return float((p[p > 1e-12] * np.log(p[p > 1e-12] / q[p > 1e-12])).sum())


def test_tsne_goes_on_after_exaggeration(spark, sf, monkeypatch):
    """A run of few steps isn't all exaggeration, and the query asks for all steps at the usual perplexity."""
    x = groups(200)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, w array<double>")
    y = np.array([r.x for r in embed.embed_tsne(df, perplexity=10.0, iterations=100).orderBy("cell_id").collect()])
    assert _divergence(x, y, 10.0) < 1
    asked = []
    monkeypatch.setattr(embed, "embed_tsne", lambda weights, *a, **b: asked.append((a, b)))
    catalog.queries()["tsne"](spark, sf)
    assert asked == [((), {})]
    assert [embed.exaggeration(k, 1000) > 1 for k in (0, 249, 250, 999)] == [True, True, False, False]
