"""Convex mixture models: Poisson state estimation by multiplicative sweeps, NMF, LDA, imputation.

Factors are tables: means (gene_id, m) and weights (cell_id, w), one array a
row, stored between steps in the shared folder; the one that a step moves never
comes to the driver.  One sweep updates each cell by its own entries and the
means alone, so all sweeps of a step run inside one Arrow kernel per batch of
packed cells, without a shuffle; the step for the means is the same over packed
genes.  The factor that is held fixed is broadcast while it is below
``FACTOR_BYTES``; beyond that each sweep is done as joins and aggregates, with
the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized, soft_one_hot
from .cluster import cluster_means, kmeans_pp, poisson_assign
from .matrix import CountMatrix, long_factor
from .prep import cell_normalize, cell_totals, log_norm
from .store import dropped, shared_folder, small_batches, stored

EPS = 1e-10
FACTOR_BYTES = 256 << 20


# --- one sweep as joins ----------------------------------------------------------------------


def sweep(m: CountMatrix, means: DataFrame, weights: DataFrame, k: int, regularization: float = 0.0, masked: bool = False) -> DataFrame:
    """One multiplicative update of weights (cell_id, w) with means (gene_id, m), both arrays of length ``k``.

    ``masked`` counts only present entries (zero-inflated model).
    """
    dot = F.aggregate(F.zip_with("m", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = m.entries.join(means, "gene_id").join(weights, "cell_id").withColumn("ratio", F.col("value") / (dot + EPS))
    pulls = rows.groupBy("cell_id").agg(*(F.sum(F.get("m", F.lit(j)) * F.col("ratio")).alias(f"c{j}") for j in range(k)), *(F.sum(F.get("m", F.lit(j))).alias(f"p{j}") for j in range(k)))
    sums = means.agg(*(F.sum(F.get("m", F.lit(j))).alias(f"s{j}") for j in range(k)))
    cells = weights.join(cell_totals(m), "cell_id").join(pulls, "cell_id", "left").crossJoin(F.broadcast(sums))  # one row

    def updated(j: int):
        w = F.get("w", F.lit(j))
        push = F.coalesce(f"p{j}", F.lit(0.0)) if masked else F.col(f"s{j}")
        divisor = 1 + w / (2 * F.col("total") + 1e-8) * (regularization + push - F.coalesce(f"c{j}", F.lit(0.0)))
        return F.when(divisor > 0, w / divisor).otherwise(0.0)

    return cells.select("cell_id", F.array(*(updated(j) for j in range(k))).alias("w"))


# --- all sweeps of a step in a kernel --------------------------------------------------------


def sweeps(idx: np.ndarray, val: np.ndarray, offs: np.ndarray, m: np.ndarray, w: np.ndarray, n: int, regularization: float = 0.0, tol: float = 0.0, masked: bool = False) -> np.ndarray:
    """``n`` sweeps over packed rows: entries (idx, val) by offsets, fixed factor m, rows' weights w.

    With ``tol`` the rows of this batch stop when their root mean square change
    is below it.  ``masked`` counts only present entries (zero-inflated model).
    """
    size = np.diff(offs)
    row, full = np.repeat(np.arange(len(size)), size), np.flatnonzero(size)
    at, mi = offs[:-1][full], m[idx]
    total = np.zeros(len(size))
    total[full] = np.add.reduceat(val, at) if len(full) else []
    lam = 1 / (2 * total + 1e-8)
    pull, push = np.zeros_like(w), np.broadcast_to(m.sum(0), w.shape)
    if masked:
        push = np.zeros_like(w)
        push[full] = np.add.reduceat(mi, at, axis=0) if len(full) else 0
    for _ in range(n):
        if len(full):
            ratio = val / (np.einsum("ij,ij->i", mi, w[row]) + EPS)
            pull[full] = np.add.reduceat(mi * ratio[:, None], at, axis=0)
        divisor = 1 + lam[:, None] * w * (regularization + push - pull)
        new = np.where(divisor > 0, w / np.where(divisor > 0, divisor, 1), 0.0)
        change, w = new - w, new
        if tol > 0 and np.sqrt(np.mean(change**2)) < tol:
            break
    return w


def objective_gradient(x: np.ndarray, m: np.ndarray, w: np.ndarray, eps: float = 1e-8) -> tuple[float, np.ndarray]:
    """The Poisson cost of one packed block (genes x cells, per gene) and its gradient by w (k x cells)."""
    d = m @ w + eps
    return float((d - x * np.log(d)).sum() / len(x)), (m.sum(0)[:, None] - m.T @ (x / d)) / len(x)


def row_gradients(val: np.ndarray, row: np.ndarray, at: np.ndarray, full: np.ndarray, mi: np.ndarray, sums: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the Poisson cost sum(mw) - sum(x ln mw) and its gradient by w."""
    mw = np.einsum("ij,ij->i", mi, w[row]) + EPS
    cost, grad = w @ sums, np.broadcast_to(sums, w.shape).copy()
    if len(full):
        cost[full] -= np.add.reduceat(val * np.log(mw), at)
        grad[full] -= np.add.reduceat(mi * (val / mw)[:, None], at, axis=0)
    return cost, grad


def quasi_newton(idx: np.ndarray, val: np.ndarray, offs: np.ndarray, m: np.ndarray, w: np.ndarray, n: int, memory: int = 5) -> np.ndarray:
    """Up to ``n`` steps of L-BFGS with bounds at 0 over packed rows, each row by itself, all at a time.

    Variables at their bound with the gradient pointing out are held; the others
    move along the two-loop direction, projected, halved until the cost falls.
    """
    size = np.diff(offs)
    row, full = np.repeat(np.arange(len(size)), size), np.flatnonzero(size)
    at, mi, sums = offs[:-1][full], m[idx], m.sum(0)
    value = lambda x: row_gradients(val, row, at, full, mi, sums, x)
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    cost, grad = value(w)

    def picked(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """The entries of some rows, as ``row_gradients`` takes them."""
        n, some = size[rows], np.flatnonzero(size[rows])
        start = np.cumsum(n) - n
        places = np.repeat(offs[:-1][rows] - start, n) + np.arange(n.sum())
        return val[places], np.repeat(np.arange(len(rows)), n), start[some], some, mi[places]

    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(n):
        free = ~((w <= 0) & (grad > 0))
        q, used = np.where(free, grad, 0.0), []
        for s, y, rho in reversed(steps):
            a = rho * dot(s, q)
            q = q - a[:, None] * y
            used.append(a)
        if steps:
            s, y, rho = steps[-1]
            gain = np.where(rho > 0, 1 / np.maximum(rho * dot(y, y), 1e-300), 1.0)
            q = q * gain[:, None]
        else:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1.0) * np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-3)
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            q = q + (a - rho * dot(y, q))[:, None] * s
        q = np.where(free, q, 0.0)
        bad = dot(q, grad) <= 0
        q[bad] = np.where(free, grad, 0.0)[bad]
        length, new, new_cost, new_grad = np.ones(len(w)), w, cost, grad
        for t in range(30):
            if t:  # only the rows that are still too high are looked at again
                back, length[high] = np.flatnonzero(high), length[high] * 0.5
                new[back] = np.maximum(w[back] - length[back, None] * q[back], 0.0)
                part = picked(back)
                new_cost[back], new_grad[back] = row_gradients(*part, sums, new[back])
            else:
                new = np.maximum(w - length[:, None] * q, 0.0)
                new_cost, new_grad = value(new)
            high = new_cost > cost + 1e-4 * dot(grad, new - w) + 1e-12 * np.abs(cost)
            if not high.any():
                break
        worse = new_cost > cost
        new, new_cost, new_grad = np.where(worse[:, None], w, new), np.where(worse, cost, new_cost), np.where(worse[:, None], grad, new_grad)
        s, y = new - w, new_grad - grad
        curve = dot(s, y)
        steps = [*steps, (s, y, np.where(curve > 1e-12, 1 / np.where(curve > 1e-12, curve, 1.0), 0.0))][-memory:]
        still = np.abs(new - w).max(initial=0) <= 1e-10 * max(1.0, np.abs(w).max(initial=0))
        w, cost, grad = new, new_cost, new_grad
        if still:
            break
    return w


def _sent(factor: DataFrame, key: str, array: str):
    """A factor's sorted ids and rows, broadcast, or None if they are beyond FACTOR_BYTES."""
    k = factor.select(F.size(array).alias("k")).first()
    if k is None or factor.count() * (k.k + 1) * 8 > FACTOR_BYTES:
        return None if k else factor.sparkSession.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros((0, 0))))
    return factor.sparkSession.sparkContext.broadcast(arrays_of(factor, key, array))


def arrays_of(factor: DataFrame, key: str, array: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and rows of a factor that the caller knows to be small."""
    t = factor.select(key, array).toArrow()
    ids, rows = np.asarray(t.column(key)).astype(np.int64), t.column(array).combine_chunks()
    x = np.asarray(rows.flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


class Layout:
    """A matrix's packed cells, persisted when first used, and the steps over them."""

    def __init__(self, m: CountMatrix):
        self.m, self.kept = m, None

    @property
    def packed(self) -> DataFrame:
        if self.kept is None:
            self.kept = self.m.packed_cells().persist()
        return self.kept

    def free(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None

    def step(self, fixed: DataFrame, moving: DataFrame, kernel: Callable[..., np.ndarray]) -> DataFrame | None:
        """Rows (cell_id, w) of ``moving`` after the kernel, with ``fixed`` (gene_id, m) sent to all tasks; None if that is too large to send."""
        sent = _sent(fixed, "gene_id", "m")
        if sent is None:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others, m = sent.value
            for b in batches:
                lists, rows = b.column("idx"), b.column("w")
                offs = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                idx = np.searchsorted(others, np.asarray(lists.flatten()))
                w = np.asarray(rows.flatten()).reshape(b.num_rows, -1).astype(float)
                out = kernel(idx, np.asarray(b.column("val").flatten()), offs, m, w)
                yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array(list(out), pa.list_(pa.float64()))], ["cell_id", "w"])

        return self.packed.join(moving, "cell_id").select("cell_id", "idx", "val", "w").mapInArrow(run, "cell_id long, w array<double>")


class Steps:
    """Stores what each step makes, by side, and removes what no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.count = spark, shared_folder(spark), {}, 0

    def keep(self, side: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{side}-{self.count}"
        out = stored(df, path)
        if side in self.paths:
            dropped(self.spark, self.paths[side])
        self.paths[side] = path
        return out


def _swapped(df: DataFrame) -> DataFrame:
    """Means as the weights of the transposed matrix, or the other way round."""
    if "m" in df.columns:
        return df.select(F.col("gene_id").alias("cell_id"), F.col("m").alias("w"))
    return df.select(F.col("cell_id").alias("gene_id"), F.col("w").alias("m"))


@dataclass
class Estimate:
    """Means (gene_id, m) and weights (cell_id, w) as arrays, and the cost that they minimise.

    ``m``, ``w``, ``genes`` and ``cells`` bring them to the driver, for factors of evaluation sizes.
    """

    means: DataFrame
    weights: DataFrame
    cost: float

    @classmethod
    def of(cls, spark: SparkSession, genes: np.ndarray, cells: np.ndarray, m: np.ndarray, w: np.ndarray, cost: float) -> Estimate:
        return cls(frame_of(spark, "gene_id", genes, "m", m), frame_of(spark, "cell_id", cells, "w", w), cost)

    @cached_property
    def _m(self) -> tuple[np.ndarray, np.ndarray]:
        return arrays_of(self.means, "gene_id", "m")

    @cached_property
    def _w(self) -> tuple[np.ndarray, np.ndarray]:
        return arrays_of(self.weights, "cell_id", "w")

    genes = property(lambda self: self._m[0])
    m = property(lambda self: self._m[1])
    cells = property(lambda self: self._w[0])
    w = property(lambda self: self._w[1])

    @property
    def spark(self) -> SparkSession:
        return self.means.sparkSession

    def imputed_at(self, places: DataFrame) -> DataFrame:
        """MW at the given (gene_id, cell_id)."""
        from .matrix import reconstruction_at

        return reconstruction_at(places, self.means, self.weights)


def frame_of(spark: SparkSession, key: str, ids: np.ndarray, name: str, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({key: pa.array(ids, pa.int64()), name: pa.array(list(x), pa.list_(pa.float64()))}))


def dimension(df: DataFrame, key: str) -> np.ndarray:
    """Sorted ids of a list of genes that is to be held in memory; an error beyond FACTOR_BYTES."""
    if df.count() * 8 > FACTOR_BYTES:
        raise ValueError("genes beyond FACTOR_BYTES: transpose the matrix so that the longer side are the cells")
    return np.sort(np.asarray(df.select(key).toArrow().column(key)).astype(np.int64))


def _dot(a: str = "m", b: str = "w") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _sums(df: DataFrame, array: str) -> np.ndarray:
    """The sum of a factor's rows."""
    rows = df.select(F.posexplode(array).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s")).collect()  # one row per component
    return np.array([r.s for r in sorted(rows, key=lambda r: r.k)])


def poisson_cost(m: CountMatrix, means: DataFrame, weights: DataFrame) -> float:
    """(sum of MW - sum over entries of x ln MW) / genes."""
    logs = m.entries.join(means, "gene_id").join(weights, "cell_id").agg(F.sum(F.col("value") * F.log(_dot() + EPS))).first()[0] or 0.0
    return float((_sums(means, "m") @ _sums(weights, "w") - logs) / max(1, m.n_genes()))


#: Genes whose sums travel in one row between tasks, and first-level groups of tasks.
SUM_GENES, SUM_GROUPS = 1024, 64


#: Rows of the matrix that a task multiplies at a time.
ROWS_AT_ONCE = 1024


def _gram_times(packed: DataFrame, ids: np.ndarray, q: np.ndarray, centred_over: int = 0) -> np.ndarray:
    """The sum over packed rows a of a'(aq); of rows less their mean over so many places if ``centred_over``.

    Tasks' sums are added by blocks of places in two levels.
    """
    sc, tasks, n = packed.sparkSession.sparkContext, packed.rdd.getNumPartitions(), q.shape[1]
    sent = sc.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, qq = sent.value
        total, even, whole = np.zeros_like(qq), np.zeros(n), qq.sum(0)
        for b in (part.slice(a, ROWS_AT_ONCE) for part in batches for a in range(0, part.num_rows, ROWS_AT_ONCE)):
            idx, val, row, size = _flat(b, places)
            scores = _row_sums(qq[idx] * val[:, None], size)
            if centred_over:
                mean = np.bincount(row, val, minlength=len(size)) / centred_over
                scores -= np.outer(mean, whole)
                even += mean @ scores
            np.add.at(total, idx, scores[row] * val[:, None])
        total -= even
        starts, group = range(0, len(total), SUM_GENES), TaskContext.get().partitionId() % SUM_GROUPS
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([group] * len(starts), pa.int32()), pa.array([total[a : a + SUM_GENES].tobytes() for a in starts], pa.binary())], ["start", "part", "sum"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("sum"))
        return pa.table({"start": t.column("start")[:1], "part": t.column("part")[:1], "sum": pa.array([total.tobytes()], pa.binary())})

    kind, total = "start long, part int, sum binary", np.zeros_like(q)
    once = packed.mapInArrow(run, kind)
    if tasks > SUM_GROUPS:
        once = once.groupBy("start", "part").applyInArrow(add, kind)
    for r in once.groupBy("start").applyInArrow(add, kind).collect():  # one row per block of places
        total[r.start : r.start + SUM_GENES] = np.frombuffer(r["sum"]).reshape(-1, n)
    sent.unpersist()
    return total


def truncated_svd(m: CountMatrix, n: int, seed: int = 0, passes: int = 5, centred: bool = False) -> tuple[DataFrame, np.ndarray | DataFrame, np.ndarray]:
    """(scores (cell_id, vec), right vectors (genes, n), singular values); of cells less their mean if ``centred``.

    Subspace iteration on the shorter side: each pass sums a'(aq) over the cells
    (or over the genes, where there are more genes than cells) of a partition,
    and only the shorter side x n numbers meet on the driver.  The mean enters
    as a correction of rank one; rows stay sparse.  If the shorter side is beyond
    ``FACTOR_BYTES`` both sides are tables.  Where the genes are the longer side
    the right vectors come as (gene_id, vec).
    """
    n_genes, n_cells = m.n_genes(), m.n_cells()
    if min(n_genes, n_cells) * n * 8 > FACTOR_BYTES:
        from .tall import svd_tables

        return svd_tables(m, n, seed, passes, centred)
    if n_cells < n_genes:
        return _svd_by_cells(m, max(1, min(n, n_cells)), seed, passes, centred)
    genes = dimension(m.genes, "gene_id")
    packed = stored(m.packed_cells())
    n = max(1, min(n, len(genes)))
    mean = np.zeros(len(genes))
    if centred:
        from .prep import gene_mean_var

        t = gene_mean_var(m).select("gene_id", "mean").toArrow()
        mean[np.searchsorted(genes, np.asarray(t.column("gene_id")))] = np.asarray(t.column("mean"))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(genes), n)))[0]
    sc = packed.sparkSession.sparkContext
    product = lambda q: _gram_times(packed, genes, q) - n_cells * np.outer(mean, mean @ q)
    for _ in range(passes):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    e, v = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-e)
    q, values = q @ v[:, order], np.sqrt(np.maximum(e[order], 0))
    shift = mean @ q
    sent = sc.broadcast((genes, q))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qq = sent.value
        for b in batches:
            idx, val, _, size = _flat(b, ids)
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array(list(_row_sums(qq[idx] * val[:, None], size) - shift), pa.list_(pa.float64()))], ["cell_id", "vec"])

    return packed.mapInArrow(scores, "cell_id long, vec array<double>"), q, values


def _svd_by_cells(m: CountMatrix, n: int, seed: int, passes: int, centred: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores (cell_id, vec), right vectors (gene_id, vec), singular values) where the cells are the shorter side."""
    spark = m.cells.sparkSession
    small_batches(spark)
    cells, packed = dimension(m.cells, "cell_id"), stored(m.packed_genes())
    over = len(cells) if centred else 0
    u = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(cells), n)))[0]
    for _ in range(passes):
        u = np.linalg.qr(_gram_times(packed, cells, u, over))[0]
    z = _gram_times(packed, cells, u, over)
    small = u.T @ z
    e, v = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-e)
    values = np.sqrt(np.maximum(e[order], 0))
    good = e[order] > max(float(e.max(initial=0.0)), 1e-300) * 1e-15
    inverse = np.where(good, 1 / np.where(good, values, 1.0), 0.0)
    u = u @ v[:, order]
    sent, whole = spark.sparkContext.broadcast((cells, u * inverse)), (u * inverse).sum(0)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, uu = sent.value
        for b in batches:
            idx, val, row, size = _flat(b, ids)
            x = _row_sums(uu[idx] * val[:, None], size)
            if over:
                x -= np.outer(np.bincount(row, val, minlength=len(size)) / over, whole)
            yield pa.RecordBatch.from_arrays([b.column("gene_id"), pa.array(list(x), pa.list_(pa.float64()))], ["gene_id", "vec"])

    return frame_of(spark, "cell_id", cells, "vec", z @ v[:, order] * inverse), packed.mapInArrow(right, "gene_id long, vec array<double>"), values


def _flat(b: pa.RecordBatch, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(np.asarray(b.column("idx").offsets))
    return np.searchsorted(ids, np.asarray(b.column("idx").flatten())), np.asarray(b.column("val").flatten()), np.repeat(np.arange(len(size)), size), size


def _row_sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, full = np.zeros((len(size), x.shape[1])), np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(x, (np.cumsum(size) - size)[full], axis=0)
    return out


def kmeans_labels(scores: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cell_id, cluster) by k-means on array vectors."""
    data = scores.select("cell_id", array_to_vector("vec").alias("features")).persist()
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    out = stored(model.transform(data).select("cell_id", F.col("prediction").alias("cluster")))
    data.unpersist()
    return out


def initial_factors(m: CountMatrix, k: int, initialization: str = "tsvd", seed: int = 0, max_assign_weight: float = 0.75, use_log_norm: bool = True, labels: DataFrame | None = None, means: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Start (means (gene_id, m), weights (cell_id, w)) by one of: tsvd, km, cluster, kmpp, random; or from labels or known means."""
    if labels is None and means is not None:
        labels = poisson_assign(m, long_factor(means, "gene_id", "m"))
    elif labels is None and initialization == "tsvd":
        scores, _, _ = truncated_svd(log_norm(m) if use_log_norm else m, min(50, max(1, m.n_genes() - 1)), seed)
        labels = kmeans_labels(scores, k, seed)
    elif labels is None and initialization == "km":
        scores, _, _ = truncated_svd(m, min(10, max(1, m.n_genes() - 1)), seed)
        labels = kmeans_labels(scores, k, seed)
    elif labels is None and initialization == "cluster":
        from .cluster import poisson_cluster

        labels, _ = poisson_cluster(m, k, seed=seed)
    elif labels is None and initialization == "kmpp":
        centers, labels = kmeans_pp(m, k, seed=seed)
    elif labels is None:
        picked = m.cells.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(k)
        rows = [r.cell_id for r in picked.collect()]
        place = F.coalesce(*(F.when(F.col("cell_id") == c, F.lit(j)) for j, c in enumerate(rows)))
        own = m.entries.where(F.col("cell_id").isin(rows)).select("gene_id", place.alias("k"), F.col("value").alias("m"))
        labels = poisson_assign(m, _dense(m, own, k))
        means = _arrays(_dense(m, own, k).withColumn("m", F.col("m") + 1e-8))
    labels = stored(labels)
    if means is None:
        means = _arrays(cluster_means(m, labels, k).withColumn("m", F.col("m") + 1e-8))
    return means, labels.select("cell_id", soft_one_hot(F.col("cluster"), k, max_assign_weight).alias("w"))


def _dense(m: CountMatrix, rows: DataFrame, k: int) -> DataFrame:
    """(gene_id, k, m) for all genes and components, absent ones 0."""
    grid = m.genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return grid.join(rows, ["gene_id", "k"], "left").fillna(0.0, ["m"])


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("m"))


def poisson_estimate_state(
    m: CountMatrix, k: int, init_means: DataFrame | None = None, init_weights: DataFrame | None = None, max_iters: int = 30, tol: float = 0.0, inner_max_iters: int = 100, normalize: bool = True,
    initialization: str = "tsvd", max_assign_weight: float = 0.75, run_w_first: bool = True, constrain_w: bool = False, regularization: float = 0.0, seed: int = 0, on_iteration: Callable[[int], None] | None = None, masked: bool = False, use_log_norm: bool = True, method: str = "NoLips",
) -> Estimate:
    """Alternates weights and means; returns both and the cost (lower is better).

    ``init_weights`` may be arrays (cell_id, w) or labels (cell_id, cluster).
    ``masked`` counts only present entries: the zero-inflated variant.
    ``method`` is NoLips (multiplicative sweeps) or L-BFGS-B (``quasi_newton``),
    which needs the fixed factor below FACTOR_BYTES and knows no regularization.
    """
    if method not in ("NoLips", "L-BFGS-B"):
        raise ValueError(f"unknown method {method!r}")
    if method == "L-BFGS-B" and (masked or regularization):
        raise ValueError("L-BFGS-B is for the plain Poisson model")
    labels = init_weights if init_weights is not None and "cluster" in init_weights.columns else None
    start_m, start_w = initial_factors(m, k, initialization, seed, max_assign_weight, use_log_norm, labels, init_means)
    if init_weights is not None and labels is None:
        start_w = init_weights
    steps, by_cell, by_gene = Steps(m.cells.sparkSession), Layout(m), Layout(m.T)
    means, weights = steps.keep("m", start_m.select("gene_id", "m")), steps.keep("w", start_w.select("cell_id", "w"))

    def moved(side: str, layout: Layout, fixed: DataFrame, moving: DataFrame, reg: float) -> DataFrame:
        if method == "L-BFGS-B":
            out = layout.step(fixed, moving, lambda idx, val, offs, f, x: quasi_newton(idx, val, offs, f, x, inner_max_iters))
            if out is None:
                raise ValueError("factors beyond FACTOR_BYTES: use NoLips")
            return out
        out = layout.step(fixed, moving, lambda idx, val, offs, f, x: sweeps(idx, val, offs, f, x, inner_max_iters, reg, tol, masked))
        for _ in range(inner_max_iters if out is None else 0):
            moving = out = steps.keep(f"{side}-sweep", sweep(layout.m, fixed, moving, k, reg, masked))
        return out if out is not None else moving

    try:
        for it in range(max_iters):
            for side in ("w", "m") if run_w_first else ("m", "w"):
                if side == "w":
                    new = moved("w", by_cell, means, weights, regularization)
                    weights = steps.keep("w", new.select("cell_id", _to_one("w").alias("w")) if constrain_w else new)
                else:
                    means = steps.keep("m", _swapped(moved("m", by_gene, _swapped(weights), _swapped(means), 0.0)))
            if on_iteration:
                on_iteration(it)
        if normalize:
            even = F.transform("w", lambda _: F.lit(1.0 / k))
            weights = steps.keep("w", weights.select("cell_id", F.when(F.aggregate("w", F.lit(0.0), lambda s, v: s + v) > 0, _to_one("w")).otherwise(even).alias("w")))
        return Estimate(means, weights, poisson_cost(m, means, weights))
    finally:
        by_cell.free()
        by_gene.free()


def _to_one(array: str) -> Column:
    total = F.aggregate(array, F.lit(0.0), lambda s, v: s + v)
    return F.transform(array, lambda v: v / F.greatest(total, F.lit(1e-300)))


def update_m_init(m: CountMatrix, old_means: DataFrame, weights: DataFrame) -> DataFrame:
    """(gene_id, k, m) for all genes: the given means, and X W' for genes without."""
    known = old_means.select("gene_id").distinct()
    new = m.drop_genes(known)
    rows = new.entries.join(weights, "cell_id").groupBy("gene_id", "k").agg(F.sum(F.col("value") * F.col("w")).alias("m"))
    grid = new.genes.crossJoin(weights.select("k").distinct())  # one row per component
    return old_means.select("gene_id", "k", "m").unionByName(grid.join(rows, ["gene_id", "k"], "left").fillna(0.0, ["m"]))


def update_m(m: CountMatrix, old: Estimate, inner_max_iters: int = 100) -> Estimate:
    """Means of all genes with the weights held: the start above, then sweeps for every gene."""
    steps, by_gene = Steps(m.cells.sparkSession), Layout(m.T)
    k = old.weights.select(F.size("w")).first()[0]
    means = steps.keep("m", _arrays(update_m_init(m, long_factor(old.means, "gene_id", "m"), long_factor(old.weights, "cell_id", "w"))))
    fixed, moving = _swapped(old.weights), _swapped(means)
    new = by_gene.step(fixed, moving, lambda idx, val, offs, f, x: sweeps(idx, val, offs, f, x, inner_max_iters))
    for _ in range(inner_max_iters if new is None else 0):
        moving = steps.keep("m-sweep", sweep(m.T, fixed, moving, k))
    means = steps.keep("m", _swapped(moving if new is None else new))
    by_gene.free()
    return Estimate(means, old.weights, poisson_cost(m, means, old.weights))


def _random_factor(ids: DataFrame, key: str, name: str, k: int, seed: int) -> DataFrame:
    """Uniform on 0.1 .. 1.1 by a hash of the id."""
    unit = lambda j: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(j)), F.lit(1 << 40)) / float(1 << 40)
    return ids.select(key, F.array(*(unit(j) + 0.1 for j in range(k))).alias(name))


def _least_squares(m: CountMatrix, means: DataFrame, weights: DataFrame, k: int, inner: int) -> DataFrame:
    """``inner`` multiplicative updates of the weights: entries join the means once, then rows need k x k numbers only."""
    parts = [F.sum(F.col("value") * F.get("m", F.lit(j))) for j in range(k)]
    tops = m.entries.join(means, "gene_id").groupBy("cell_id").agg(F.array(*parts).alias("top"))
    gram = _gram(means, "m", k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("w").flatten()).reshape(-1, k)
            top = np.asarray(b.column("top").flatten()).reshape(-1, k)
            for _ in range(inner):
                x = x * top / (x @ gram + 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array(list(x), pa.list_(pa.float64()))], ["cell_id", "w"])

    none = F.array(*[F.lit(0.0)] * k)
    return weights.join(tops, "cell_id", "left").select("cell_id", "w", F.coalesce("top", none).alias("top")).mapInArrow(run, "cell_id long, w array<double>")


def _gram(df: DataFrame, array: str, k: int) -> np.ndarray:
    """k x k products of a factor's components."""
    row = df.agg(*(F.sum(F.get(array, F.lit(i)) * F.get(array, F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def nmf(m: CountMatrix, k: int, init_means: DataFrame | None = None, init_weights: DataFrame | None = None, max_iters: int = 100, normalize_w: bool = True, seed: int = 0, update_weights: bool = True, inner: int = 5) -> Estimate:
    """Least squares with non-negative factors by multiplicative updates, ``inner`` for each side in turn."""
    steps, m = Steps(m.cells.sparkSession), m.kept()
    means = steps.keep("m", init_means if init_means is not None else _random_factor(m.genes, "gene_id", "m", k, 2 * seed))
    weights = steps.keep("w", init_weights if init_weights is not None else _random_factor(m.cells, "cell_id", "w", k, 2 * seed + 1))
    for _ in range(max(1, max_iters // inner)):
        if update_weights:
            weights = steps.keep("w", _least_squares(m, means, weights, k, inner))
        means = steps.keep("m", _swapped(_least_squares(m.T, _swapped(weights), _swapped(means), k, inner)))
    both = m.entries.join(means, "gene_id").join(weights, "cell_id").agg(F.sum(F.col("value") * F.col("value")).alias("xx"), F.sum(F.col("value") * _dot()).alias("xp")).first()
    cost = 0.5 * ((both.xx or 0.0) - 2 * (both.xp or 0.0) + float((_gram(means, "m", k) * _gram(weights, "w", k)).sum()))
    if normalize_w:
        weights = steps.keep("w", weights.select("cell_id", _to_one("w").alias("w")))
    return Estimate(means, weights, float(cost))


def nmf_start(m: CountMatrix, labels: DataFrame, k: int, kind: str = "enhanced", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(means (gene_id, m), weights (cell_id, w)) from labels: means of the clusters; weights 'basic' (nearly one-hot),
    'enhanced' (by distances to the means, as ``fuzzy_weights``) or 'nmf' (one NMF's weights with these means)."""
    from .likelihood import poisson_dist_mat
    from .matrix import packed_factor

    centers = stored(cluster_means(m, labels, k))
    means = _arrays(centers)
    if kind == "basic":
        return means, labels.select("cell_id", F.transform(soft_one_hot(F.col("cluster"), k, 1.0), lambda v: v + 1e-4).alias("w"))
    if kind == "enhanced":
        return means, packed_factor(fuzzy_weights(poisson_dist_mat(m, centers)), "cell_id", "w")
    if kind == "nmf":
        held = means.select("gene_id", F.transform("m", lambda v: v + 1e-6).alias("m"))
        return means, nmf(m, k, held, max_iters=5, seed=seed).weights
    raise ValueError(f"unknown start {kind!r}")


def nearest_weights(m: CountMatrix, means: DataFrame, k: int, use_log_norm: bool = False, weight: float = 0.75) -> DataFrame:
    """(cell_id, w): most of the weight on the component whose means (gene_id, k, m) are nearest by Poisson distance; values log-normalised first if asked."""
    from .likelihood import best_center, poisson_dist_mat

    labels = best_center(poisson_dist_mat(log_norm(m) if use_log_norm else m, means), "dist", largest=False)
    return labels.select("cell_id", soft_one_hot(F.col("cluster"), k, weight).alias("w"))


def log_norm_nmf(m: CountMatrix, k: int, **options) -> Estimate:
    return nmf(log_norm(m), k, **options)


def norm_nmf(m: CountMatrix, k: int, **options) -> Estimate:
    return nmf(cell_normalize(m), k, **options)


def fuzzy_weights(distances: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(cell_id, k, w) from distances (cell_id, k, dist): 1 / sum over l of (d_k / d_l)^2."""
    inverse = distances.withColumn("i", 1 / F.pow(F.greatest(F.col("dist"), F.lit(eps)), 2))
    sums = inverse.groupBy("cell_id").agg(F.sum("i").alias("s"))
    return inverse.join(sums, "cell_id").select("cell_id", "k", (F.col("i") / F.col("s")).alias("w"))


DISTRIBUTIONS = {
    "poiss": "poisson", "poisson": "poisson", "nb": "nb", "zip": "zip",
    "lognorm": "lognorm", "log-normal": "lognorm", "lognormal": "lognorm", "gaussian": "gaussian", "norm": "gaussian", "normal": "gaussian", "none": "none",
}


def run_state_estimation(m: CountMatrix, k: int, dist: str = "Poiss", reps: int = 1, seed: int = 0, **options) -> Estimate:
    """By distribution name (unknown: Poisson, with a warning); k = 0 chooses it by the gap statistic; the best of ``reps``."""
    import warnings

    kind = DISTRIBUTIONS.get(dist.lower())
    if kind is None:
        warnings.warn(f"unknown distribution {dist!r}; using Poisson", stacklevel=2)
        kind = "poisson"
    if k == 0:
        from .cluster import select_k

        k = min(select_k(m, n_reference=6, seed=seed), m.n_genes() - 1, m.n_cells() - 1)
    best = None
    for rep in range(reps):
        s = seed + rep
        if kind == "lognorm":
            got = log_norm_nmf(m, k, seed=s, **options)
        elif kind == "gaussian":
            got = norm_nmf(m, k, seed=s, **options)
        elif kind == "zip":
            got = poisson_estimate_state(m, k, masked=True, seed=s, **options)
        elif kind == "nb":
            from .dispersed import nb_estimate_state

            got = nb_estimate_state(m, k, seed=s, **options)[0]
        elif kind == "none":
            got = run_baseline(m, k, seed=s)
        else:
            got = poisson_estimate_state(m, k, seed=s, **options)
        best = got if best is None or got.cost < best.cost else best
    return best


def run_baseline(m: CountMatrix, k: int, seed: int = 0) -> Estimate:
    """The start alone: truncated SVD without log normalization, k-means, weight 0.95; cost 0."""
    means, weights = initial_factors(m, k, "tsvd", seed, 0.95, False)
    return Estimate(stored(means), stored(weights), 0.0)


__all__ = ["Estimate", "Layout", "fuzzy_weights", "log_norm_nmf", "nearest_weights", "nmf", "nmf_start", "norm_nmf", "normalized", "poisson_estimate_state", "run_baseline", "run_state_estimation", "sweep", "sweeps", "truncated_svd", "update_m", "update_m_init"]
