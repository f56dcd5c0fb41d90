"""Lineages: curves through clusters in two dimensions, edges along and between them, pseudotime."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from .reduce import mds
from .store import stored


def fit_polynomial(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Least-squares coefficients by rising power, and the sum of their standard errors."""
    a = np.vander(x, n, increasing=True)
    c, *_ = np.linalg.lstsq(a, y, rcond=None)
    free = len(x) - n
    if free <= 0:
        return c, np.inf
    s2 = float(((y - a @ c) ** 2).sum()) / free
    return c, float(np.sqrt(np.maximum(np.diag(s2 * np.linalg.pinv(a.T @ a)), 0)).sum())


def fit_fourier(x: np.ndarray, y: np.ndarray, n: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """a0, a1, b1, ... and the frequency last, by Gauss-Newton from one period over the range; and the errors' sum."""
    w = 2 * np.pi / max(float(np.ptp(x)), 1e-9)
    terms = max(1, (n - 2) // 2)

    def design(w: float) -> np.ndarray:
        return np.column_stack([np.full(len(x), 0.5), *(f(k * w * x) for k in range(1, terms + 1) for f in (np.sin, np.cos))])

    c = np.linalg.lstsq(design(w), y, rcond=None)[0]
    for _ in range(rounds):
        a = design(w)
        slope = sum(k * x * (c[2 * k - 1] * np.cos(k * w * x) - c[2 * k] * np.sin(k * w * x)) for k in range(1, terms + 1))
        full = np.column_stack([a, slope])
        move = np.linalg.lstsq(full, y - a @ c, rcond=None)[0]
        if not np.isfinite(move).all() or abs(move[-1]) < 1e-9:
            break
        c, w = c + move[:-1], w + float(np.clip(move[-1], -0.2 * abs(w), 0.2 * abs(w)))
    a = design(w)
    free = len(x) - a.shape[1] - 1
    error = np.inf if free <= 0 else float(np.sqrt(np.maximum(np.diag(((y - a @ c) ** 2).sum() / free * np.linalg.pinv(a.T @ a)), 0)).sum())
    return np.append(c, w), error


def fourier_values(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    w, c = c[-1], c[:-1]
    return c[0] / 2 + sum(c[2 * k - 1] * np.sin(k * w * x) + c[2 * k] * np.cos(k * w * x) for k in range(1, (len(c) + 1) // 2))


def fitted_curves(points: DataFrame, curve: str = "poly", dimensions: int = 6) -> DataFrame:
    """(cell_id, cluster, x, y, coord, fx, fy) of points (cell_id, cluster, x, y): each on its cluster's curve.

    Of y by x and x by y the one with the smaller errors is taken; ``coord`` is
    its free coordinate.  Clusters under two cells keep their points; a small one
    has fewer coefficients.  A cluster's cells meet in one task, as its curve needs.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, y, n = g["x"].to_numpy(), g["y"].to_numpy(), len(g)
        if n < 2:
            return g.assign(coord=x, fx=x, fy=y)
        k = min(dimensions, n - 1)
        best = None
        for swap in (False, True):
            u, v = (y, x) if swap else (x, y)
            c, error = fit_polynomial(u, v, max(1, k)) if curve == "poly" else fit_fourier(u, v, max(3, k))
            out = np.vander(u, len(c), increasing=True) @ c if curve == "poly" else fourier_values(u, c)
            if best is None or error < best[0]:
                best = (error, swap, u, out)
        _, swap, u, out = best
        return g.assign(coord=u, fx=out if swap else u, fy=u if swap else out)

    return points.select("cell_id", "cluster", "x", "y").groupBy("cluster").applyInPandas(lambda g: fit(g)[["cell_id", "cluster", "x", "y", "coord", "fx", "fy"]], "cell_id long, cluster int, x double, y double, coord double, fx double, fy double")


def curve_edges(points: DataFrame, coord: str = "coord") -> DataFrame:
    """(src, dst) of cells that follow each other by coordinate within a cluster."""
    after = F.lead("cell_id").over(W.partitionBy("cluster").orderBy(coord, "cell_id"))
    return points.select(F.col("cell_id").alias("src"), after.alias("dst")).where("dst is not null")


#: Halvings of the squares' width at most and at a time, and pairs of places for each place that are few enough to look at.
LEVELS, STRIDE, PAIRS = 48, 2, 8


def nearest_links(points: DataFrame, x: str = "fx", y: str = "fy") -> DataFrame:
    """(src, dst): for each cluster the closest pair with a cell of another one.

    Squares of a cluster meet squares that hold another one.  No pair of places
    is nearer than its squares' boxes, and the least distance of the cells that
    stand for squares bounds the cluster's closest pair, so pairs of squares
    farther apart than that go; the others are halved until few pairs of places
    are left, however far apart the clusters lie.  Of a cluster's cells at one
    place the least id is taken.
    """
    places = stored(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("cluster", F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min("cell_id").alias("cell_id")))
    ends = places.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"), F.min("cluster").alias("c0"), F.max("cluster").alias("c1")).first()
    if ends.c0 == ends.c1:
        return places.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst")).limit(0)
    whole = max(ends.x1 - ends.x0, ends.y1 - ends.y0) or 1.0

    def squares(level: int, side: str, *keys: str) -> DataFrame:
        """The box of each square's places, how many there are, and the first and last cluster's cell that stands for it."""
        cell = [F.floor((F.col(c) - F.lit(low)) / F.lit(whole / 2**level)).alias(f"g{c}") for c, low in (("x", ends.x0), ("y", ends.y0))]
        one = F.struct("cluster", "x", "y")
        out = places.select("*", *cell).groupBy(*keys, "gx", "gy").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))), F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b"))
        up = [F.floor(F.col(f"g{c}") / 2**STRIDE).alias(f"{side}_up_{c}") for c in "xy"]
        return out.select(*(F.col(c).alias(f"{side}_{c}") for c in out.columns), *up)

    def near(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("(t_a.cluster <> s_cluster or t_b.cluster <> s_cluster)")
        apart = sum(F.pow(F.greatest(F.col(f"t_low_{c}") - F.col(f"s_high_{c}"), F.col(f"s_low_{c}") - F.col(f"t_high_{c}"), F.lit(0.0)), 2) for c in "xy")
        length = lambda t: F.when(F.col(f"{t}.cluster") != F.col("s_cluster"), sum(F.pow(F.col(f"{t}.{c}") - F.col(f"s_a.{c}"), 2) for c in "xy"))
        pairs = stored(pairs.select("s_cluster", "s_gx", "s_gy", "t_gx", "t_gy", (F.col("s_n") * F.col("t_n").cast("double")).alias("n"), apart.alias("apart"), F.least(length("t_a"), length("t_b")).alias("most")))
        most = pairs.groupBy("s_cluster").agg(F.min("most").alias("bound"))
        # distances count to 9 places, so what may tie stays
        return pairs.join(most, "s_cluster").where(F.col("apart") <= F.col("bound") * (1 + 1e-12) + 2e-9).select("s_cluster", "s_gx", "s_gy", "t_gx", "t_gy", "n")

    level, left = 0, stored(near(squares(0, "s", "cluster").crossJoin(squares(0, "t"))))  # at most four squares of each cluster, and four in all
    while level < LEVELS and (left.agg(F.sum("n")).first()[0] or 0) > PAIRS * ends.n:
        level += STRIDE
        up = left.select("s_cluster", *(F.col(f"{a}_g{c}").alias(f"{a}_up_{c}") for a in "st" for c in "xy"))
        left = stored(near(up.join(squares(level, "s", "cluster"), ["s_cluster", "s_up_x", "s_up_y"]).join(squares(level, "t"), ["t_up_x", "t_up_y"])))
    at = lambda a: places.select(F.col("cluster").alias(f"{a}_cluster"), F.col("cell_id").alias(f"{a}_id"), *(F.col(c).alias(f"{a}_{c}") for c in "xy"), *(F.floor((F.col(c) - F.lit(low)) / F.lit(whole / 2**level)).alias(f"{a}_g{c}") for c, low in (("x", ends.x0), ("y", ends.y0))))
    d = F.round(F.pow(F.col("s_x") - F.col("t_x"), 2) + F.pow(F.col("s_y") - F.col("t_y"), 2), 9)
    met = left.drop("n").join(at("s"), ["s_cluster", "s_gx", "s_gy"]).join(at("t"), ["t_gx", "t_gy"]).where("s_cluster <> t_cluster")
    links = met.groupBy("s_cluster").agg(F.min(F.struct(d.alias("d"), F.col("s_id").alias("src"), F.col("t_id").alias("dst"))).alias("e"))
    return links.select("e.src", "e.dst")


def run_lineage(means: DataFrame, weights: DataFrame, curve: str = "poly", dimensions: int = 6) -> tuple[DataFrame, DataFrame]:
    """(points on their curves, edges (src, dst))."""
    means, weights = stored(means), stored(weights)
    places = mds(means, weights, 2).join(weights.select("cell_id", argmax(F.col("w")).alias("cluster")), "cell_id")
    points = stored(fitted_curves(places.select("cell_id", "cluster", F.get("x", F.lit(0)).alias("x"), F.coalesce(F.get("x", F.lit(1)), F.lit(0.0)).alias("y")), curve, dimensions))
    return points, curve_edges(points).unionByName(nearest_links(points)).distinct()


def pseudotime(start: int, edges: DataFrame, points: DataFrame, x: str = "fx", y: str = "fy") -> DataFrame:
    """(cell_id, time): the least sum of squared lengths from ``start``, null where no path leads.

    See ``graph_distances``.
    """
    at = lambda name: points.select(F.col("cell_id").alias(name), F.col(x).alias(f"x_{name}"), F.col(y).alias(f"y_{name}"))
    length = F.pow(F.col("x_src") - F.col("x_dst"), 2) + F.pow(F.col("y_src") - F.col("y_dst"), 2)
    one = edges.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", length.alias("d"))
    return graph_distances(start, one, points.select("cell_id")).withColumnRenamed("distance", "time")


#: Directed edges that one task may hold.
CORE_EDGES = 1_000_000


def graph_distances(start: int, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, distance) over undirected edges (src, dst, d).

    While there are more than ``CORE_EDGES`` edges, nodes of one or two
    neighbours are taken out, none beside another, and their edges joined into
    one: a curve of n cells shrinks in about log n rounds.  What is left is
    walked by one task, or, if it stays larger, relaxed by joins.  Then the nodes
    taken out get their distances from their neighbours, the last ones first.
    """
    both = edges.select("src", "dst", "d").union(edges.select("dst", "src", "d")).where("src <> dst")
    both, taken, number = stored(both.groupBy("src", "dst").agg(F.min("d").alias("d"))), [], 0
    while both.count() > CORE_EDGES:
        number += 1
        ends = both.groupBy("src").agg(F.count("*").alias("n"), F.min(F.struct("dst", "d")).alias("a"), F.max(F.struct("dst", "d")).alias("b"))
        free = ends.where((F.col("n") <= 2) & (F.col("src") != start)).withColumn("turn", F.xxhash64("src", F.lit(number)))
        beside = both.join(free.select(F.col("src").alias("dst"), F.col("turn").alias("other")), "dst").groupBy("src").agg(F.min("other").alias("other"))
        out = free.join(beside, "src", "left").where("other is null or turn < other")
        out = stored(out.select("src", "n", F.col("a.dst").alias("a"), F.col("a.d").alias("da"), F.col("b.dst").alias("b"), F.col("b.d").alias("db")))
        if out.isEmpty():
            break
        taken.append(out)
        gone = out.select("src")
        joined = out.where("n = 2").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("da") + F.col("db")).alias("d"))
        kept = both.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst", "d")
        both = stored(kept.union(joined).union(joined.select("dst", "src", "d")).groupBy("src", "dst").agg(F.min("d").alias("d")))
    times = _walked(start, both) if both.count() <= CORE_EDGES else _relaxed(start, both)
    for out in reversed(taken):
        at = lambda c: times.select(F.col("cell_id").alias(c), F.col("time").alias(f"t_{c}"))  # noqa: B023, E731
        new = out.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.col("src").alias("cell_id"), F.least(F.col("t_a") + F.col("da"), F.col("t_b") + F.col("db")).alias("time"))
        times = stored(times.union(new.where("time is not null")))
    return nodes.join(times, "cell_id", "left").select("cell_id", F.col("time").alias("distance"))


def _walked(start: int, both: DataFrame) -> DataFrame:
    """(cell_id, time) by Dijkstra's algorithm in one task; the start alone if it has no edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, list[tuple[int, float]]] = {}
        for b in batches:
            for s, t, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                near.setdefault(s, []).append((t, d))
        done: dict[int, float] = {}
        heap = [(0.0, start)]
        while heap:
            time, node = heapq.heappop(heap)
            if node not in done:
                done[node] = time
                for t, d in near.get(node, ()):
                    if t not in done:
                        heapq.heappush(heap, (time + d, t))
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int64()), pa.array(list(done.values()), pa.float64())], ["cell_id", "time"])

    return stored(both.select("src", "dst", "d").coalesce(1).mapInArrow(run, "cell_id long, time double").groupBy("cell_id").agg(F.min("time").alias("time")))


def _relaxed(start: int, both: DataFrame) -> DataFrame:
    """(cell_id, time) by relaxing all edges at once until nothing shrinks."""
    times, before = both.sparkSession.createDataFrame([(start, 0.0)], "cell_id long, time double"), None
    while True:
        new = both.join(times.withColumnRenamed("cell_id", "src"), "src").select(F.col("dst").alias("cell_id"), (F.col("time") + F.col("d")).alias("time"))
        times = stored(times.union(new).groupBy("cell_id").agg(F.min("time").alias("time")))
        now = tuple(times.agg(F.count("*"), F.round(F.sum("time"), 9)).first())
        if now == before:
            return times
        before = now
