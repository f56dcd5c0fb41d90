"""Negative binomial and zero-inflated fits per gene, and the negative binomial mixture."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma_np, lgamma_np, trigamma_np
from .expansion import Sums, sums_over
from .factor import Estimate, Layout, Steps, _sent, _swapped, _to_one, initial_factors
from .matrix import CountMatrix, components, full_factor
from .prep import gene_mean_var, nb_genes
from .store import small_batches, stored


def nb_moments(m: CountMatrix) -> DataFrame:
    """(gene_id, p, r) by moments: p = 1 - mean / var, r = mean (1 - p) / p; null where the variance isn't above the mean."""
    s = gene_mean_var(m).where("var > mean and mean > 0")
    p = 1 - F.col("mean") / F.col("var")
    return s.select("gene_id", p.alias("p"), (F.col("mean") * (1 - p) / p).alias("r"))


def nb_row_ll(r: float, p: float, x: np.ndarray, zeros: int) -> float:
    """Log-likelihood of one gene's entries x and of so many absent ones."""
    return float((lgamma_np(r + x) - lgamma_np(np.array(r)) - lgamma_np(x + 1) + x * np.log(p)).sum() + (len(x) + zeros) * r * np.log1p(-p))


def zip_row_ll(lam: float, pi: float, x: np.ndarray, zeros: int) -> float:
    """Log-likelihood of one gene's positive entries x and of so many zeros."""
    return float(np.log((1 - pi) * np.exp(x * np.log(lam) - lam - lgamma_np(x + 1)) + 1e-10).sum() + zeros * np.log(pi + (1 - pi) * np.exp(-lam) + 1e-10))


#: Steps of a fit at most, how far ln r may go from the moments' start, and the step of ln r that ends it.
NB_STEPS, NB_REACH, NB_CLOSE = 60, 6.0, 1e-9


def nb_slopes(histogram: DataFrame, r: DataFrame) -> DataFrame:
    """(gene_id, first, second): over a gene's entries the sums of digamma(r + x) - digamma(r) and of its derivative.

    ``histogram`` is (gene_id, value, n), ``r`` (gene_id, r).  A gene's values
    may lie in many tasks: each adds up its own, and Spark the tasks' sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            genes, at = np.unique(np.asarray(b.column("gene_id")), return_inverse=True)
            r, x, n = (np.asarray(b.column(c)).astype(float) for c in ("r", "value", "n"))
            sums = [np.bincount(at, n * (f(r + x) - f(r)), minlength=len(genes)) for f in (digamma_np, trigamma_np)]
            yield pa.RecordBatch.from_arrays([pa.array(genes.astype(np.int64)), *map(pa.array, sums)], ["gene_id", "first", "second"])

    return histogram.join(r, "gene_id").mapInArrow(run, "gene_id long, first double, second double").groupBy("gene_id").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


def nb_fit(m: CountMatrix) -> DataFrame:
    """(gene_id, p, r): maximum likelihood from the moments' start; null where the variance isn't above the mean.

    With p = mean / (r + mean) the likelihood's slope in r needs a gene's
    (value, number) table only, of which zeros drop out.  All genes take Newton
    steps in ln r at once, halving the bracket where a step would leave it, until
    none moves; a step is one pass over these tables.  A gene whose slope has one
    sign over the whole bracket is at that end of it.
    """
    n = m.n_cells()
    stats = stored(gene_mean_var(m).select("gene_id", "mean", "var"))
    start = F.log(F.greatest(F.col("mean") ** 2 / (F.col("var") - F.col("mean")), F.lit(1e-6)))
    now = stats.where("var > mean and mean > 0").select("gene_id", "mean", start.alias("at"), (start - NB_REACH).alias("lo"), (start + NB_REACH).alias("hi"), F.lit(False).alias("done"))
    now = stored(now)
    histogram = stored(m.entries.join(now.select("gene_id"), "gene_id", "left_semi").groupBy("gene_id", "value").agg(F.count("*").alias("n")))
    for end, sign in (("hi", 1), ("lo", -1)):
        outer = nb_slopes(histogram, now.where("not done").select("gene_id", F.exp(end).alias("r"))).select("gene_id", "first")
        r = F.exp(end)
        beyond = sign * (F.col("first") + n * F.log(r / (r + F.col("mean")))) >= 0
        rows = now.join(outer, "gene_id", "left").withColumn("beyond", ~F.col("done") & F.coalesce(beyond, F.lit(False)))
        now = stored(rows.select("gene_id", "mean", F.when(F.col("beyond"), F.col(end)).otherwise(F.col("at")).alias("at"), "lo", "hi", (F.col("done") | F.col("beyond")).alias("done")))
    for _ in range(NB_STEPS):
        moving = now.where("not done")
        if moving.isEmpty():
            break
        rows = moving.join(nb_slopes(histogram, moving.select("gene_id", F.exp("at").alias("r"))), "gene_id")
        r = F.exp("at")
        slope = F.col("first") + n * F.log(r / (r + F.col("mean")))
        # the slope's derivative by ln r
        curve = r * (F.col("second") + n * (1 / r - 1 / (r + F.col("mean"))))
        rows = rows.withColumns({"slope": slope, "curve": curve})
        rows = rows.withColumns({"lo": F.when(F.col("slope") > 0, F.col("at")).otherwise(F.col("lo")), "hi": F.when(F.col("slope") > 0, F.col("hi")).otherwise(F.col("at"))})
        newton = F.col("at") - F.col("slope") / F.when(F.col("curve") != 0, F.col("curve"))
        rows = rows.withColumn("next", F.when(newton.between(F.col("lo"), F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        ended = F.abs(F.col("next") - F.col("at")) <= NB_CLOSE
        now = stored(now.where("done").unionByName(rows.select("gene_id", "mean", F.col("next").alias("at"), "lo", "hi", ended.alias("done"))))
    r = F.exp("at")
    fitted = now.select("gene_id", (F.col("mean") / (r + F.col("mean"))).alias("p"), r.alias("r"))
    return m.genes.join(fitted, "gene_id", "left")


def zip_fit(m: CountMatrix, steps: int = 200) -> DataFrame:
    """(gene_id, lam, pi) by maximum likelihood: EM needs a gene's number of entries and their sum only, and takes all genes of a batch at once."""
    n = m.n_cells()
    stats = m.genes.join(m.entries.groupBy("gene_id").agg(F.count("*").cast("double").alias("some"), F.sum("value").alias("total")), "gene_id", "left").fillna(0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, total = (np.asarray(b.column(c)) for c in ("some", "total"))
            lam, pi = zip_em(some, total, n, steps)
            yield pa.RecordBatch.from_arrays([b.column("gene_id"), pa.array(lam), pa.array(pi)], ["gene_id", "lam", "pi"])

    return stats.mapInArrow(run, "gene_id long, lam double, pi double")


def zip_em(some: np.ndarray, total: np.ndarray, n: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(lam, pi) of genes with so many positive entries among n cells; without any, 0 and 1."""
    full = some > 0
    lam, pi = total / np.maximum(some, 1), np.where(full, 0.5 * (1 - some / n), 1.0)
    moving = full.copy()
    for _ in range(steps):
        if not moving.any():
            break
        zero = np.where(pi > 0, pi / np.maximum(pi + (1 - pi) * np.exp(-lam), 1e-300) * (n - some), 0.0)
        new_pi, new_lam = zero / n, total / np.maximum(n - zero, 1e-12)
        change = np.abs(new_pi - pi) + np.abs(new_lam - lam)
        pi, lam = np.where(moving, new_pi, pi), np.where(moving, new_lam, lam)
        moving &= change >= 1e-10
    return np.where(full, lam, 0.0), pi


#: How far above the largest place now the sums over absent entries are made to hold, and entries that a task works on at a time.
ROOM, ENTRIES = 4.0, 1 << 18


def _nb_rows(val: np.ndarray, offs: np.ndarray, f: np.ndarray, r: np.ndarray, y: np.ndarray, own: np.ndarray | None, left: np.ndarray, absent: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(y, left) after up to ``left`` multiplicative updates that don't raise sum (X + R) ln(D + R) - X ln D.

    ``f`` and ``r`` are the fixed factor's rows and the dispersions at the
    entries, ``own`` the rows' dispersions where these belong to them.  A row that
    leaves the places for which ``absent`` holds stops there.
    """
    size = np.diff(offs)
    row, full = np.repeat(np.arange(len(size)), size), np.flatnonzero(size)
    at, y, left = offs[:-1][full], y.copy(), left.copy()
    rate = np.ones(len(y)) if own is None else own + 1e-10
    share = np.ones(len(y)) if own is None else own / rate
    while True:
        z = y / rate[:, None]
        go = (left > 0) & ~(z > absent.top).any(1)
        if not go.any():
            return y, left
        d = np.einsum("ij,ij->i", f, y[row]) + 1e-10
        pull, push = np.zeros_like(y), np.zeros_like(y)
        if len(full):
            pull[full] = np.add.reduceat(f * (val / d)[:, None], at, axis=0)
            push[full] = np.add.reduceat(f * (val / (d + r))[:, None], at, axis=0)
        push[go] += absent.reciprocals(z[go]) * share[go, None]
        y[go] = (y * (pull / (push + 1e-12)))[go]
        left[go] -= 1


def _nb_top(moving: DataFrame, k: int, own: bool) -> np.ndarray:
    """The largest place of each component, with some room."""
    z = lambda j: F.get("w", F.lit(j)) / ((F.get("w", F.lit(k)) + 1e-10) if own else F.lit(1.0))
    return ROOM * np.array([x or 0.0 for x in moving.agg(*(F.max(z(j)) for j in range(k))).first()])


def _nb_sources(fixed: DataFrame, k: int, own: bool) -> DataFrame:
    """(q, v) of a fixed factor (gene_id, m), whose last column are dispersions unless the moving rows have their own."""
    if own:
        return fixed.select(F.col("m").alias("q"), F.col("m").alias("v"))
    r, rows = F.get("m", F.lit(k)), F.slice("m", 1, k)
    return fixed.select(F.transform(rows, lambda x: x / (r + 1e-10)).alias("q"), F.transform(rows, lambda x: x * (r / (r + 1e-10))).alias("v"))


def _nb_step(steps: Steps, side: str, layout: Layout, fixed: DataFrame, moving: DataFrame, k: int, own: bool, n: int) -> DataFrame:
    """Rows (cell_id, w) of the moving factor after ``n`` updates; dispersions are the last column of one of the two, and stay.

    What absent entries add is a sum over the fixed factor at each row's place
    (``expansion``), so a row meets its own entries only.
    """
    sources = stored(_nb_sources(fixed, k, own))
    sent, now = _sent(fixed, "gene_id", "m"), moving.withColumn("left", F.lit(n))
    done = None
    while True:
        absent = fixed.sparkSession.sparkContext.broadcast(sums_over(sources, _nb_top(now, k, own)))
        rows = stored(_nb_joined(layout.m, fixed, now, k, own, absent) if sent is None else _nb_packed(layout, sent, now, k, own, absent))
        ended, now = rows.where("left = 0").select("cell_id", "w"), rows.where("left > 0")
        done = ended if done is None else done.unionByName(ended)
        if now.isEmpty():
            return steps.keep(side, done)


def _nb_out(ids: pa.Array, y: np.ndarray, x: np.ndarray, own: bool, left: np.ndarray) -> pa.RecordBatch:
    w = np.concatenate([y, x[:, -1:]], axis=1) if own else y
    return pa.RecordBatch.from_arrays([ids, pa.array(list(w), pa.list_(pa.float64())), pa.array(left, pa.int32())], ["cell_id", "w", "left"])


def _nb_packed(layout: Layout, sent, moving: DataFrame, k: int, own: bool, absent) -> DataFrame:
    """All updates of a row in its task, which has the fixed factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, m = sent.value
        for b in batches:
            lists = b.column("idx")
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            ids, val, left = np.asarray(lists.flatten()), np.asarray(b.column("val").flatten()), np.asarray(b.column("left"))
            x = np.asarray(b.column("w").flatten()).astype(float).reshape(b.num_rows, -1)
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1)
                part = slice(ends[a], ends[z])
                f = m[np.searchsorted(others, ids[part])].reshape(-1, m.shape[1])
                size = np.diff(ends[a : z + 1])
                r = np.repeat(x[a:z, -1], size) if own else f[:, -1]
                y, rest = _nb_rows(val[part], ends[a : z + 1] - ends[a], f[:, :k], r, x[a:z, :k], x[a:z, -1] if own else None, left[a:z], absent.value)
                yield _nb_out(b.column("cell_id").slice(a, z - a), y, x[a:z], own, rest)
                a = z

    small_batches(moving.sparkSession)
    return layout.packed.join(moving, "cell_id").select("cell_id", "idx", "val", "w", "left").mapInArrow(run, "cell_id long, w array<double>, left int")


def _nb_joined(m: CountMatrix, fixed: DataFrame, moving: DataFrame, k: int, own: bool, absent) -> DataFrame:
    """One update, for fixed factors that are too large to send: entries meet both factors' rows by joins."""
    f, y = (lambda j: F.get("m", F.lit(j))), (lambda j: F.get("w", F.lit(j)))
    d = sum((f(j) * y(j) for j in range(k)), F.lit(1e-10))
    rows = m.entries.join(fixed, "gene_id").join(moving, "cell_id").select("cell_id", "m", "value", d.alias("d"), (y(k) if own else f(k)).alias("r"))
    terms = [F.sum(f(j) * (F.col("value") / (F.col("d") + extra))) for extra in (F.lit(0.0), F.col("r")) for j in range(k)]
    sums = rows.groupBy("cell_id").agg(*(t.alias(f"s{j}") for j, t in enumerate(terms)))
    both = moving.join(sums, "cell_id", "left").select("cell_id", "w", "left", F.array(*(F.coalesce(f"s{j}", F.lit(0.0)) for j in range(2 * k))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, s = (np.asarray(b.column(c).flatten()).astype(float).reshape(b.num_rows, -1) for c in ("w", "s"))
            y, rate = x[:, :k], x[:, -1:] + 1e-10 if own else 1.0
            share = x[:, -1:] / rate if own else 1.0
            y = y * (s[:, :k] / (s[:, k:] + absent.value.reciprocals(y / rate) * share + 1e-12))
            yield _nb_out(b.column("cell_id"), y, x, own, np.asarray(b.column("left")) - 1)

    return both.mapInArrow(run, "cell_id long, w array<double>, left int")


def _nb_cost(m: CountMatrix, with_r: DataFrame, weights: DataFrame, k: int) -> float:
    """The sum over all genes and cells of (X + R) ln(D + R) - X ln D."""
    r = F.get("m", F.lit(k))
    sources = stored(with_r.select(F.transform(F.slice("m", 1, k), lambda x: x / (r + 1e-10)).alias("q"), F.array(r).alias("v")))
    absent = m.cells.sparkSession.sparkContext.broadcast(sums_over(sources, _nb_top(weights, k, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.asarray(b.column("w").flatten()).astype(float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([float(absent.value.logarithms(z).sum())])], ["s"])

    dense = weights.select("w").mapInArrow(run, "s double").agg(F.sum("s")).first()[0] or 0.0
    base = with_r.agg(F.sum(r * F.log(r + 1e-10))).first()[0] or 0.0
    d = sum((F.get("m", F.lit(j)) * F.get("w", F.lit(j)) for j in range(k)), F.lit(1e-10))
    some = m.entries.join(with_r, "gene_id").join(weights, "cell_id").agg(F.sum(F.col("value") * (F.log(d + r) - F.log(d)))).first()[0] or 0.0
    return float(dense + base * m.n_cells() + some)


def nb_estimate_state(m: CountMatrix, k: int, r: DataFrame | None = None, max_iters: int = 10, inner_max_iters: int = 40, normalize: bool = True, seed: int = 0, initialization: str = "tsvd", init_weights: DataFrame | None = None) -> tuple[Estimate, DataFrame]:
    """(estimate, r (gene_id, r)): a mixture with negative binomial genes of fixed dispersion; genes that aren't over-dispersed go.

    All genes count for every cell, absent entries too; their sums are made by
    boxes of like rows (``expansion``), not by pairs.
    """
    m = m.kept()
    if r is None:
        m = m.select_genes(stored(nb_genes(m).where("is_nb").select("gene_id"))).kept()
        r = stored(nb_fit(m).select("gene_id", F.coalesce("r", F.lit(1e6)).alias("r")))
    steps, by_cell, by_gene = Steps(m.cells.sparkSession), Layout(m), Layout(m.T)
    start_m, start_w = initial_factors(m, k, initialization, seed, labels=init_weights)
    weights = steps.keep("w", start_w)
    # the genes' own dispersions ride along as a last column
    means = steps.keep("m", start_m.join(r, "gene_id", "left").select("gene_id", F.concat("m", F.array(F.coalesce("r", F.lit(1e6)))).alias("m")))
    for _ in range(max_iters):
        weights = _nb_step(steps, "w", by_cell, means, weights, k, False, inner_max_iters)
        means = steps.keep("m", _swapped(_nb_step(steps, "out", by_gene, _swapped(weights), _swapped(means), k, True, inner_max_iters)))
    if normalize:
        weights = steps.keep("w", weights.select("cell_id", _to_one("w").alias("w")))
    cost = _nb_cost(m, means, weights, k)
    by_cell.free()
    by_gene.free()
    return Estimate(means.withColumn("m", F.slice("m", 1, k)), weights, cost / max(1, m.n_genes())), r


#: Distinct rows of a factor in one packed row, and products in one array.
BLOCK_ROWS, BLOCK_PRODUCTS = 4096, 1 << 20


def _blocks(rows: DataFrame, array: str, extra: str | None = None) -> DataFrame:
    """(vec, extra, n): distinct rows of a factor and how often each occurs, some thousand to a packed row, stored."""
    keys = [array, extra] if extra else [array]
    counted = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                r = np.asarray(part.column(extra)).astype(float) if extra else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.asarray(part.column(array).flatten()), r, np.asarray(part.column("n")))], ["vec", "extra", "n"])

    return stored(counted.mapInArrow(pack, "vec binary, extra binary, n binary"))


def sum_over_pairs(by_gene: DataFrame, by_cell: DataFrame, term: Callable[[np.ndarray, np.ndarray], np.ndarray], extra: str) -> DataFrame:
    """One row (dense): the sum over all genes and cells of term(MW, the gene's ``extra``), of (gene_id, m, extra) and (cell_id, w).

    Equal rows are counted and their products made once.  The others are made
    in blocks that stay in their tasks: no row per gene and cell, and nothing of
    that size is shuffled.
    """
    genes = _blocks(by_gene, "m", extra).repartition(4 * by_gene.sparkSession.sparkContext.defaultParallelism)
    cells = _blocks(by_cell, "w").select(F.col("vec").alias("other"), F.col("n").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for row in (r for b in batches for r in b.to_pylist()):
            r, n, times = (np.frombuffer(row[c]) for c in ("extra", "n", "times"))
            m, w = np.frombuffer(row["vec"]).reshape(len(n), -1), np.frombuffer(row["other"]).reshape(len(times), -1)
            step = max(1, BLOCK_PRODUCTS // len(w))
            for a in range(0, len(m), step):
                z = slice(a, a + step)
                total += float(n[z] @ (term(m[z] @ w.T, r[z, None]) @ times))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    return genes.crossJoin(cells).mapInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("dense"))


def _objective(m: CountMatrix, means: DataFrame, weights: DataFrame, by_gene: DataFrame, extra: str, absent: Callable, present: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One row (cost): the terms of absent entries over all genes and cells, and what entries differ from them, over genes."""
    ks = components(means, weights)
    gene_rows = stored(full_factor(means, "gene_id", "m", ks).join(by_gene, "gene_id"))
    cell_rows = stored(full_factor(weights, "cell_id", "w", ks))
    dot = F.aggregate(F.zip_with("m", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = m.entries.join(gene_rows, "gene_id").join(cell_rows, "cell_id").select("value", extra, dot.alias("d"))
    some = rows.agg(F.coalesce(F.sum(present(F.col("value"), F.col("d"), F.col(extra))), F.lit(0.0)).alias("some"))
    both = sum_over_pairs(gene_rows, cell_rows, absent, extra).crossJoin(some).crossJoin(m.genes.agg(F.count("*").alias("n")))
    return both.select(((F.col("dense") + F.col("some")) / F.col("n")).alias("cost"))


def nb_objective(m: CountMatrix, means: DataFrame, weights: DataFrame, r: DataFrame) -> DataFrame:
    """One row (cost): (sum over all genes and cells of (X + R) ln(MW + R) - X ln MW) / genes, of long factors (gene_id, k, m), (cell_id, k, w).

    The dense sum is what the model asks for; see ``sum_over_pairs``.
    """
    absent = lambda d, r: r * np.log(d + 1e-10 + r)
    present = lambda x, d, r: x * (F.log(d + 1e-10 + r) - F.log(d + 1e-10))
    return _objective(m, means, weights, r, "r", absent, present)


def zip_objective(m: CountMatrix, means: DataFrame, weights: DataFrame, z: DataFrame, eps: float = 1e-10) -> DataFrame:
    """One row (cost): minus the log-likelihood of the zero-inflated mixture, over genes; z (gene_id, z) is each gene's inflation, the factorial is left out."""

    def present(x: Column, d: Column, z: Column) -> Column:
        zero = F.log(z + (1 - z) * F.exp(-d) + eps)
        return F.when(x > 0, zero - (F.log(1 - z + eps) + x * F.log(d + eps) - d)).otherwise(0.0)

    return _objective(m, means, weights, z, "z", lambda d, z: -np.log(z + (1 - z) * np.exp(-d) + eps), present)
