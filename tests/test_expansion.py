"""Sums over absent entries by boxes against sums by pairs, and the negative binomial mixture against dense updates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymix.operators import dispersed, expansion, factor
from tallymix.operators.matrix import CountMatrix


def _rows(spark, q, v):
    return factor.frame_of(spark, "id", np.arange(len(q)), "q", q).join(factor.frame_of(spark, "id", np.arange(len(q)), "v", v), "id").select("q", "v").persist()


@pytest.mark.parametrize("spread", [0.05, 0.6, 3.0])
def test_sums_by_boxes_are_those_by_pairs(spark, spread):
    rng = np.random.default_rng(1)
    q, v = np.exp(rng.normal(-1, spread, (6000, 2))), rng.random((6000, 3))
    q[:50, 0] = 0
    z = rng.random((40, 2)) * [2.0, 0.3]
    sums = expansion.sums_over(_rows(spark, q, v), z.max(0))
    assert sums.boxes and len(sums.q) < 6000  # not by pairs
    d = 1 + z @ q.T
    np.testing.assert_allclose(sums.reciprocals(z), (1 / d) @ v, rtol=1e-12)
    np.testing.assert_allclose(sums.logarithms(z), np.log(d) @ v, rtol=1e-12)


def test_like_rows_cost_no_pairs(spark):
    rng = np.random.default_rng(2)
    cost = []
    for n in (4000, 16000):
        q = 0.1 + 0.2 * rng.random((n, 3))
        sums = expansion.sums_over(_rows(spark, q, q), np.ones(3))
        cost.append(len(sums.q) + sum(b.sums.shape[1] for b in sums.boxes))
    assert cost[1] < 1.5 * cost[0] < 4000


def _dense(x, r, m, w, rounds, n):
    def moved(x, r, f, y):
        for _ in range(n):
            d = y @ f.T + 1e-10
            y = y * ((x / d) @ f) / (((x + r) / (d + r)) @ f + 1e-12)
        return y

    for _ in range(rounds):
        w = moved(x.T, r[None], m, w)
        m = moved(x, r[:, None], w, m)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    d = m @ w.T + 1e-10
    return m, w, ((x + r[:, None]) * np.log(d + r[:, None]) - x * np.log(d)).sum() / len(x)


@pytest.mark.parametrize(("sent", "room"), [(True, 4.0), (False, 4.0), (True, 1.0)])
def test_nb_mixture_is_that_of_dense_updates(spark, monkeypatch, sent, room):
    """Also with a factor too large to send, which was an error, and where rows leave the places that the sums hold for."""
    monkeypatch.setattr(dispersed, "ROOM", room)
    if not sent:
        monkeypatch.setattr(factor, "FACTOR_BYTES", 8)
    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, (300, 260)).astype(float)
    x[5], x[:, 7] = 0, 0
    g, c = np.nonzero(x)
    entries = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(g, c, strict=True)], "gene_id long, cell_id long, value double")
    m = CountMatrix(entries, spark.range(300).select(F.col("id").alias("gene_id")), spark.range(260).select(F.col("id").alias("cell_id")))
    r = m.genes.select("gene_id", (1.0 + F.pmod("gene_id", F.lit(5))).alias("r"))
    labels = m.cells.select("cell_id", F.pmod("cell_id", F.lit(2)).cast("int").alias("cluster"))
    e, _ = dispersed.nb_estimate_state(m, 2, r, 2, 2, init_weights=labels)
    start_m, start_w = factor.initial_factors(m, 2, labels=labels)
    want = _dense(x, 1.0 + np.arange(300) % 5, factor.arrays_of(start_m, "gene_id", "m")[1], factor.arrays_of(start_w, "cell_id", "w")[1], 2, 2)
    np.testing.assert_allclose(e.m, want[0], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(e.w, want[1], rtol=1e-9, atol=1e-12)
    assert e.cost == pytest.approx(want[2], rel=1e-10)
