"""Likelihoods, objectives and distances between cells and centers.

Centers and factors are long tables (gene_id, k, m) and (cell_id, k, w).  Terms
of absent entries are added once per center: f(0, m) summed over all genes,
plus f(x, m) - f(0, m) over the entries.  Whether a table is broadcast is left
to the optimizer, which knows its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import lgamma, log_ncr
from .matrix import CountMatrix, components, full_factor, reconstruction_at

EPS = 1e-10


def _by_center(m: CountMatrix, centers: DataFrame, zero: Callable[[], Column], diff: Callable[[], Column], name: str) -> DataFrame:
    """(cell_id, k, name): the sum over all genes, from the term of an absent entry and an entry's difference to it."""
    base = centers.groupBy("k").agg(F.sum(zero()).alias("base"))
    sums = m.entries.join(centers, "gene_id").groupBy("cell_id", "k").agg(F.sum(diff()).alias("d"))
    grid = m.cells.crossJoin(base)  # one row per center
    return grid.join(sums, ["cell_id", "k"], "left").select("cell_id", "k", (F.col("base") + F.coalesce("d", F.lit(0.0))).alias(name))


def poisson_ll(m: CountMatrix, centers: DataFrame, eps: float = EPS) -> DataFrame:
    """(cell_id, k, ll): sum of x ln(m + eps) minus the sum of m; the factorial is left out."""
    return _by_center(m, centers, lambda: -F.col("m"), lambda: F.col("value") * F.log(F.col("m") + eps), "ll")


def poisson_dist_mat(m: CountMatrix, centers: DataFrame, eps: float = EPS) -> DataFrame:
    """(cell_id, k, dist): sum of (x - c)(ln(x + eps) - ln(c + eps)) over all genes."""
    at = lambda x: (x - F.col("m")) * (F.log(x + eps) - F.log(F.col("m") + eps))
    return _by_center(m, centers, lambda: at(F.lit(0.0)), lambda: at(F.col("value")) - at(F.lit(0.0)), "dist")


def nb_ll(m: CountMatrix, params: DataFrame) -> DataFrame:
    """(cell_id, k, ll) with params (gene_id, k, p, r): lnG(r + x) - lnG(r) + x ln p + r ln(1 - p)."""
    zero = lambda: F.col("r") * F.log(1 - F.col("p"))
    diff = lambda: lgamma(F.col("r") + F.col("value")) - lgamma(F.col("r")) + F.col("value") * F.log(F.col("p"))
    return _by_center(m, params, zero, diff, "ll")


def zip_ll(m: CountMatrix, params: DataFrame) -> DataFrame:
    """(cell_id, k, ll) with params (gene_id, k, m, z): zero-inflated Poisson of rate m and inflation z, without the factorial."""
    rate, z = F.col("m"), F.col("z")
    zero = F.when(z <= 0, -rate).otherwise(F.log(z + (1 - z) * F.exp(-rate)))
    hit = F.log(F.greatest(1 - z, F.lit(EPS))) + F.col("value") * F.log(rate + EPS) - rate
    return _by_center(m, params, lambda: zero, lambda: hit - zero, "ll")


def zinb_ll(m: CountMatrix, params: DataFrame) -> DataFrame:
    """(cell_id, k, ll) with params (gene_id, k, p, r, z): negative binomial as in ``nb_ll``, zero-inflated by z."""
    p, r, z = F.col("p"), F.col("r"), F.col("z")
    none = r * F.log(1 - p)
    zero = F.when(z <= 0, none).otherwise(F.log(z + (1 - z) * F.exp(none)))
    hit = F.log(F.greatest(1 - z, F.lit(EPS))) + lgamma(r + F.col("value")) - lgamma(r) + F.col("value") * F.log(p) + none
    return _by_center(m, params, lambda: zero, lambda: hit - zero, "ll")


def best_center(scores: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """(cell_id, cluster): the center with the best value rounded to 9 places, the least index on ties."""
    v = F.round(F.col(value), 9)
    pick = F.max_by("k", F.struct(v if largest else -v, -F.col("k")))
    return scores.groupBy("cell_id").agg(pick.cast("int").alias("cluster"))


def poisson_objective(m: CountMatrix, means: DataFrame, weights: DataFrame, eps: float = EPS) -> DataFrame:
    """One row (cost): (sum of MW - sum over entries of x ln MW) / genes.

    The first sum is, by component, the product of the factors' sums, so the product matrix is never made.
    An entry meets its gene's and its cell's components as one array each: no row per entry and component.
    """
    sums = means.groupBy("k").agg(F.sum("m").alias("sm")).join(weights.groupBy("k").agg(F.sum("w").alias("sw")), "k")
    whole = sums.agg(F.sum(F.col("sm") * F.col("sw")).alias("whole"))
    ks = components(means, weights)
    at = reconstruction_at(m.entries, full_factor(means, "gene_id", "m", ks), full_factor(weights, "cell_id", "w", ks))
    logs = at.agg(F.coalesce(F.sum(F.col("value") * F.log(F.col("mw") + eps)), F.lit(0.0)).alias("logs"))
    genes = m.genes.agg(F.count("*").alias("genes"))
    return whole.crossJoin(logs).crossJoin(genes).select(((F.col("whole") - F.col("logs")) / F.col("genes")).alias("cost"))


def frobenius_cost(m: CountMatrix, means: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (cost): half the squared norm of X - MW, by sum x^2 - 2 sum x (MW) + sum of (M'M)(WW')."""
    squares = m.entries.agg(F.sum(F.col("value") * F.col("value")).alias("squares"))
    cross = m.entries.join(means, "gene_id").join(weights, ["cell_id", "k"]).agg(F.sum(F.col("value") * F.col("m") * F.col("w")).alias("cross"))
    gram = lambda df, key, v: df.alias("a").join(df.alias("b"), key).groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("j")).agg(F.sum(F.col(f"a.{v}") * F.col(f"b.{v}")).alias(f"g{v}"))
    product = gram(means, "gene_id", "m").join(gram(weights, "cell_id", "w"), ["k", "j"]).agg(F.sum(F.col("gm") * F.col("gw")).alias("product"))
    return squares.crossJoin(cross).crossJoin(product).select((0.5 * (F.col("squares") - 2 * F.col("cross") + F.col("product"))).alias("cost"))


def poisson_test(groups: DataFrame, by: str, value: str = "value", side: str = "side", smoothing: float = 1e-5) -> DataFrame:
    """(by, w2): the statistic that two Poisson samples (side 0 and 1) have one rate; smoothing is added to each element."""
    sums = groups.groupBy(by).agg(
        *(F.sum(F.when(F.col(side) == s, F.col(value) + smoothing).otherwise(0.0)).alias(f"x{s}") for s in (0, 1)),
        *(F.sum(F.when(F.col(side) == s, 1.0).otherwise(0.0)).alias(f"n{s}") for s in (0, 1)),
    )
    return sums.where("n0 > 0 and n1 > 0").select(by, ((F.col("x1") - F.col("x0") * F.col("n1") / F.col("n0")) / F.sqrt((F.col("x0") + F.col("x1")) * F.col("n1") / F.col("n0"))).alias("w2"))


def mdl(ll: float, k: int, m: CountMatrix) -> float:
    """Description length: ll + (genes * cells + cells * k) ln(sum of X / (genes * k))."""
    import math

    total = m.entries.agg(F.sum("value")).first()[0]
    genes, cells = m.n_genes(), m.n_cells()
    return ll + (genes * cells + cells * k) * math.log(total / (genes * k))


__all__ = ["best_center", "frobenius_cost", "log_ncr", "mdl", "nb_ll", "poisson_dist_mat", "poisson_ll", "poisson_objective", "poisson_test", "zinb_ll", "zip_ll"]
