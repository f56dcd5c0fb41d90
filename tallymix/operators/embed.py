"""t-SNE on a sparse neighbour graph: one Arrow pass over stored edges a step.

Each point's affinities go to its ``3 * perplexity`` nearest, found exactly by
the metric partition, and are made symmetric by a union and a sum.  The edges
are stored once, as packed arrays, those of a point in one row, so that a step
brings each point to the driver once.  A step sends the positions and a grid to
all tasks: edges add up what pulls their points together; what drives points apart
is read from the grid, which holds the potentials of all points, smoothed from
a lattice of charges by one Fourier transform.  The driver holds the positions
(two doubles per point, at most ``POSITION_BYTES``) and the grid, and no matrix
of points by points is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest, usable
from .store import shared_folder, stored

#: What positions may take on the driver and in a broadcast.
POSITION_BYTES = 1 << 26
EDGES, POINTS = 1 << 16, 1 << 12
NODES = 3
#: Boxes of the grid along a side, at least and at most; half a unit wide where that is between.
LEAST_BOXES, MOST_BOXES = 40, 160
#: Affinities count so many times in the first quarter of the steps, in no more than EARLY of them.
EXAGGERATION, EARLY = 12.0, 250
#: The exponent is halved in at most so many steps until the perplexity fits.
HALVINGS = 60


def affinities(square: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of squared distances (infinite where there is none) to probabilities of the wanted perplexity."""
    square = square - square.min(1, keepdims=True)
    n = len(square)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / np.maximum(np.median(np.where(np.isfinite(square), square, 0), 1), 1e-300)
    finite = np.where(np.isfinite(square), square, 0)
    for _ in range(HALVINGS):
        p = np.exp(-beta[:, None] * square)
        total = p.sum(1)
        entropy = np.log(total) + beta * (p * finite).sum(1) / total
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.exp(-beta[:, None] * square)
    return p / p.sum(1, keepdims=True)


def edges(points: DataFrame, n: int, perplexity: float, metric: str | None) -> DataFrame:
    """(id, other, p): symmetric affinities that add up to 1; points are (id, v)."""
    k = int(min(n - 1, np.ceil(3 * perplexity)))
    near = nearest(points, k, "id", "v", metric=metric)
    rows = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "square"))).alias("e"))  # k at most
    rows = rows.select("id", F.col("e.other").alias("other"), F.col("e.square").alias("square"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("square").value_lengths())
            square = np.full((len(size), k), np.inf)
            square[np.arange(k)[None] < size[:, None]] = np.asarray(b.column("square").flatten())
            p = affinities(square, min(perplexity, max(1.0, k / 3)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("id")), size)), b.column("other").flatten(), pa.array(p[np.arange(k)[None] < size[:, None]])], ["id", "other", "p"])

    one = stored(rows.mapInArrow(run, "id long, other long, p double"))
    return one.union(one.select("other", "id", "p")).groupBy("id", "other").agg((F.sum("p") / (2 * n)).alias("p"))


class Grid:
    """Charges on a lattice, and the potentials that they make there."""

    def __init__(self, y: np.ndarray):
        self.low = y.min(0)
        span = float(max(np.ptp(y, axis=0).max(), 1e-9)) * (1 + 1e-9)
        self.boxes = int(np.clip(np.ceil(2 * span), LEAST_BOXES, MOST_BOXES))
        self.width = span / self.boxes
        n = NODES * self.boxes
        at, weight = self.places(y)
        charge = np.stack([np.bincount(at.ravel(), (weight * c[:, None]).ravel(), minlength=n * n) for c in (np.ones(len(y)), y[:, 0], y[:, 1])]).reshape(3, n, n)
        lag = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)) * (self.width / NODES)
        kernel = 1 / (1 + lag[:, None] ** 2 + lag[None] ** 2)
        first, second = np.fft.rfft2(kernel), np.fft.rfft2(kernel**2)
        spectrum = np.fft.rfft2(charge, (2 * n, 2 * n))
        back = lambda f: np.fft.irfft2(f, (2 * n, 2 * n))[..., :n, :n].reshape(-1, n * n)
        #: Of all points on each node: the sum of 1 / (1 + d^2), and of its square with charges 1, x and y.
        self.potential = np.concatenate([back(spectrum[:1] * first), back(spectrum * second)])
        #: The sum of 1 / (1 + d^2) over all pairs of points.
        self.z = float(charge[0].ravel() @ self.potential[0] - len(y))

    def places(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes around each point and their weights, by quadratic interpolation."""
        box = (y - self.low) / self.width
        first = np.clip(np.floor(box), 0, self.boxes - 1)
        u = (box - first) * NODES - 0.5
        w = np.stack([(u - 1) * (u - 2) / 2, -u * (u - 2), u * (u - 1) / 2], -1)
        node = (first[..., None] * NODES + np.arange(NODES)).astype(np.int64)
        at = node[:, 0, :, None] * (NODES * self.boxes) + node[:, 1, None, :]
        return at.reshape(len(y), -1), (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(y), -1)

    def push(self, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of 1 / (1 + d^2) over these points and all others, and what drives each of these away, before dividing by it."""
        at, weight = self.places(y)
        z, one, x0, x1 = ((self.potential[c][at] * weight).sum(1) for c in range(4))
        return float(z.sum() - len(y)), np.column_stack([y[:, 0] * one - x0, y[:, 1] * one - x1])


def pull(y: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points ``i`` of some edges, each once, and what pulls them; a point's edges lie side by side."""
    diff = y[i] - y[j]
    force = (p / (1 + (diff * diff).sum(1)))[:, None] * diff
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return i[first], np.add.reduceat(force, first, axis=0)


def _packed(e: DataFrame, ids: np.ndarray, folder: str) -> DataFrame:
    """Edges in rows of some ten thousand, by the place of their points in ``ids``; a point's edges lie in one row, a row's points side by side."""
    spark = e.sparkSession
    sent = spark.sparkContext.broadcast(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            i, j = (np.searchsorted(sent.value, np.asarray(b.column(c))).astype(np.int32) for c in ("id", "other"))
            held.append((i, j, np.asarray(b.column("p"))))
            if sum(len(h[0]) for h in held) >= EDGES:
                i, j, p = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(i, i[-1]))  # the last point may go on
                if cut:
                    yield made(i[:cut], j[:cut], p[:cut])
                held = [(i[cut:], j[cut:], p[cut:])]
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def made(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["i", "j", "p"])

    # as many tasks as cores, though the table be small: it is read in every step
    return stored(e.repartitionByRange(spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("id", "other").mapInArrow(pack, "i binary, j binary, p binary"), f"{folder}/edges")


def embed_tsne(weights: DataFrame, metric: str = "euclidean", seed: int = 0, perplexity: float = 30.0, iterations: int = 1000, key: str = "cell_id", vec: str = "w") -> DataFrame:
    """(cell_id, x) in two dimensions; metric euclidean, or one of ``neighbours.TERMS``.

    Points that have no place (null or not finite) are left out; one point lies at the origin.
    """
    spark = weights.sparkSession
    folder = shared_folder(spark)
    points = stored(usable(weights, key, vec), f"{folder}/input")
    n = points.count()
    if 16 * n > POSITION_BYTES:
        raise ValueError(f"positions of {n} points are beyond {POSITION_BYTES} bytes")
    ids = np.sort(points.select("id").toPandas()["id"].to_numpy(np.int64))  # bounded as positions are
    y = np.zeros((n, 2))
    if n > 1:
        y = _moved(_packed(edges(points, n, perplexity, None if metric == "euclidean" else metric), ids, folder), n, iterations, seed)
    return spark.createDataFrame(pa.table({"cell_id": pa.array(ids), "x": pa.array(y.tolist(), pa.list_(pa.float64()))}))


def exaggeration(step: int, iterations: int) -> float:
    """How many times affinities count in a step; a run of any length ends with steps in which they count once."""
    return EXAGGERATION if step < min(EARLY, iterations // 4) else 1.0


def _moved(rows: DataFrame, n: int, iterations: int, seed: int) -> np.ndarray:
    context = rows.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    y, step, gain = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    rate = max(n / EXAGGERATION / 4, 50.0)
    for k in range(iterations):
        sent = context.broadcast((y, Grid(y)))

        def forces(batches: Iterator[pa.RecordBatch], sent=sent, push=exaggeration(k, iterations)) -> Iterator[pa.RecordBatch]:
            y, grid = sent.value
            for row in (r for b in batches for r in b.to_pylist()):
                at, force = pull(y, np.frombuffer(row["i"], np.int32), np.frombuffer(row["j"], np.int32), np.frombuffer(row["p"], np.float64))
                force = push * force
                for a in range(0, len(at), POINTS):
                    force[a : a + POINTS] -= grid.push(y[at[a : a + POINTS]])[1] / max(grid.z, 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([force.tobytes()], pa.binary())], ["first", "force"])

        gradient = np.zeros((n, 2))
        for r in rows.mapInArrow(forces, "first int, force binary").collect():  # two numbers for each point
            force = np.frombuffer(r.force).reshape(-1, 2)
            gradient[r.first : r.first + len(force)] = 4 * force
        sent.destroy()
        gain = np.maximum(np.where(np.sign(gradient) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if exaggeration(k, iterations) > 1 else 0.8) * step - rate * gain * gradient
        y = y + step
        y = y - y.mean(0)
    return y
