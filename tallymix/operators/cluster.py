"""Clustering: Poisson k-means++ and hard EM, zero-inflated and negative binomial variants, k-means, gap statistic, DBSCAN, consensus."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import dbscan
from .likelihood import best_center, nb_ll, poisson_dist_mat, poisson_ll, zip_ll
from .matrix import CountMatrix
from .prep import log_norm
from .store import stored

EPS = 1e-10


def poisson_assign(m: CountMatrix, centers: DataFrame) -> DataFrame:
    """(cell_id, cluster) by the largest Poisson likelihood; centers are (gene_id, k, m)."""
    return best_center(poisson_ll(m, centers), "ll")


def cluster_means(m: CountMatrix, labels: DataFrame, k: int) -> DataFrame:
    """(gene_id, k, m) over all cells of a cluster, zeros included; a cluster without cells gets one cell's values.

    That cell has the least md5 of its id.
    """
    sizes = labels.groupBy(F.col("cluster").alias("k")).agg(F.count("*").alias("n"))
    sums = m.entries.join(labels, "cell_id").groupBy("gene_id", F.col("cluster").alias("k")).agg(F.sum("value").alias("s"))
    grid = m.genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    rows = grid.join(sizes, "k", "left").join(sums, ["gene_id", "k"], "left")
    out = rows.select("gene_id", "k", F.col("n").isNull().alias("empty"), (F.coalesce("s", F.lit(0.0)) / F.coalesce("n", F.lit(1))).alias("m"))
    spare = m.cells.agg(F.min_by("cell_id", F.md5(F.col("cell_id").cast("string"))).alias("cell_id"))
    other = m.entries.join(spare, "cell_id").select("gene_id", F.col("value").alias("other"))
    return out.join(other, "gene_id", "left").select("gene_id", "k", F.when(F.col("empty"), F.coalesce("other", F.lit(0.0))).otherwise(F.col("m")).alias("m"))


def kmeans_pp(m: CountMatrix, k: int, centers: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Poisson k-means++: (centers (gene_id, k, m), labels (cell_id, cluster)).

    Each next center is a cell drawn with a weight of its least squared distance
    to all centers so far; the draw is a race of exponentials by a hash of the
    cell's id, so it doesn't depend on partitions.  Known centers come first.
    """

    def cell(cell_id: int, j: int) -> DataFrame:
        own = m.entries.where(F.col("cell_id") == cell_id).select("gene_id", "value")
        return m.genes.join(own, "gene_id", "left").select("gene_id", F.lit(j).alias("k"), F.when(F.col("value") > 0, F.col("value")).otherwise(EPS).alias("m"))

    def unit(j: int):
        text = F.concat_ws(":", F.col("cell_id"), F.lit(seed), F.lit(j))
        return (F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long") + 1) / float((1 << 40) + 1)

    known, taken = 0, []
    if centers is None:
        first = m.cells.agg(F.min_by("cell_id", F.struct(unit(-1), "cell_id"))).first()[0]
        taken, centers, known = [first], stored(cell(first, 0)), 1
    else:
        known = centers.agg(F.max("k")).first()[0] + 1
    for j in range(known, k):
        near = poisson_dist_mat(m, centers).groupBy("cell_id").agg(F.min("dist").alias("d")).where(~F.col("cell_id").isin(taken) if taken else F.lit(True))
        race = F.when(F.col("d") > 0, -F.log(unit(j)) / (F.col("d") * F.col("d")))
        pick = near.agg(F.min_by("cell_id", F.struct(F.coalesce(race, F.lit(math.inf)), "cell_id"))).first()[0]
        taken.append(pick)
        centers = stored(centers.unionByName(cell(pick, j)))
    return centers, poisson_assign(m, centers)


def em_step(m: CountMatrix, labels: DataFrame, k: int) -> DataFrame:
    """One step of hard EM: means of the clusters, then the best cluster of each cell."""
    return poisson_assign(m, cluster_means(m, labels, k))


def poisson_cluster(m: CountMatrix, k: int, init: DataFrame | None = None, max_iters: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hard EM until no label changes: (labels (cell_id, cluster), centers (gene_id, k, m))."""
    centers, labels = kmeans_pp(m, k, init, seed)
    labels = stored(labels)
    for _ in range(max_iters):
        centers = stored(cluster_means(m, labels, k))
        new = stored(poisson_assign(m, centers))
        changed = new.alias("a").join(labels.alias("b"), "cell_id").where("a.cluster <> b.cluster").limit(1).count()
        labels = new
        if not changed:
            break
    return labels, centers


def zip_moments(m: CountMatrix) -> DataFrame:
    """(gene_id, lam, pi) by moments: pi = clip((v - m) / (m^2 + v - m), 0, 1), lam = max(0, m + v / m - 1); 0 where undefined."""
    from .prep import gene_mean_var

    s = gene_mean_var(m)
    pi = F.coalesce(F.expr("try_divide(var - mean, mean * mean + var - mean)"), F.lit(0.0))
    lam = F.coalesce(F.expr("mean + try_divide(var, mean) - 1"), F.lit(0.0))
    return s.select("gene_id", F.greatest(F.lit(0.0), lam).alias("lam"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), pi)).alias("pi"))


def _within(m: CountMatrix, labels: DataFrame, k: int) -> DataFrame:
    """(gene_id, k, n, s1, s2) of each cluster, clusters without cells left out."""
    sizes = labels.groupBy(F.col("cluster").alias("k")).agg(F.count("*").cast("double").alias("n"))
    sums = m.entries.join(labels, "cell_id").groupBy("gene_id", F.col("cluster").alias("k")).agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    return m.genes.crossJoin(sizes).join(sums, ["gene_id", "k"], "left").fillna(0.0, ["s1", "s2"])  # one row per cluster


def zip_cluster(m: CountMatrix, k: int, max_iters: int = 100, seed: int = 0, init: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hard EM with zero-inflated Poisson genes, from k-means++ or from labels ``init``: (labels, params (gene_id, k, m, z))."""
    labels = kmeans_pp(m, k, seed=seed)[1] if init is None else init
    labels, params = stored(labels), None
    for _ in range(max_iters):
        s = _within(m, labels, k).withColumns({"mean": F.col("s1") / F.col("n"), "var": F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2)})
        z = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.expr("try_divide(var - mean, mean * mean + var - mean)"), F.lit(0.0))))
        rate = F.greatest(F.lit(0.0), F.coalesce(F.expr("mean + try_divide(var, mean) - 1"), F.lit(0.0)))
        params = stored(s.select("gene_id", "k", rate.alias("m"), z.alias("z")))
        new = stored(best_center(zip_ll(m, params), "ll"))
        changed = new.alias("a").join(labels.alias("b"), "cell_id").where("a.cluster <> b.cluster").limit(1).count()
        labels = new
        if not changed:
            break
    return labels, params


def nb_cluster(m: CountMatrix, k: int, max_iters: int = 10, seed: int = 0, init: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hard EM, negative binomial for genes over-dispersed in every cluster, Poisson for the rest: (labels, params (gene_id, k, p, r, m)).

    Poisson genes have p = 0 and an infinite r.  ``init`` may give the first labels.
    """
    labels = kmeans_pp(m, k, seed=seed)[1] if init is None else init
    labels, params = stored(labels), None
    for _ in range(max_iters):
        s = _within(m, labels, k).withColumns({"mean": F.col("s1") / F.col("n"), "var": F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2)})
        s = s.withColumn("nb", (F.col("mean") < 0.9 * F.col("var")) & (F.col("mean") > 0))
        every = s.groupBy("gene_id").agg(F.bool_and("nb").alias("every"))
        p = F.expr("1 - try_divide(mean, var)")
        s = s.join(every, "gene_id").withColumns({"p": F.when(F.col("every"), p).otherwise(0.0), "r": F.when(F.col("every"), F.col("mean") * (1 - p) / p).otherwise(F.lit(math.inf))})
        params = stored(s.select("gene_id", "k", "p", "r", F.col("mean").alias("m")))
        over, rest = params.where("p > 0"), params.where("p = 0")
        genes = lambda rows: rows.select("gene_id").distinct()
        a = nb_ll(m.select_genes(genes(over)), over).withColumnRenamed("ll", "a")
        b = poisson_ll(m.select_genes(genes(rest)), rest).withColumnRenamed("ll", "b")
        both = a.join(b, ["cell_id", "k"], "full").select("cell_id", "k", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("ll"))
        new = stored(best_center(both, "ll"))
        changed = new.alias("a").join(labels.alias("b"), "cell_id").where("a.cluster <> b.cluster").limit(1).count()
        labels = new
        if not changed:
            break
    return labels, params


def _vectors(scores: DataFrame):
    from pyspark.ml.functions import array_to_vector

    return scores.select("cell_id", array_to_vector("vec").alias("features")).persist()


#: Sets of points that the gap statistic clusters at a time.
AT_ONCE = 6


def gap(scores: DataFrame, k: int, n_reference: int = 5, seed: int = 0) -> tuple[float, float]:
    """(gap, s): mean log inertia over uniform reference sets in the bounding box minus the data's; and its standard error."""
    from pyspark.ml.clustering import KMeans

    from .prep import bounding_box

    data = _vectors(scores)
    n = data.count()

    def inertia(df: DataFrame, s: int) -> float:
        if k > 1:
            cost = KMeans(k=k, seed=s, maxIter=20).fit(df).summary.trainingCost
        else:  # the spread around the mean
            from pyspark.ml.stat import Summarizer

            r = df.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).first().s
            cost = float(r.variance.toArray().sum()) * (r["count"] - 1)
        df.unpersist()
        return math.log(max(cost, 1e-300))

    box = sorted(bounding_box(scores).collect(), key=lambda r: r.k)

    def reference(b: int) -> float:
        row = F.array(*(F.lit(r.low) + F.rand(seed * 1009 + 31 * b + r.k) * F.lit(r.high - r.low) for r in box))
        return inertia(_vectors(scores.sparkSession.range(n).select(F.col("id").alias("cell_id"), row.alias("vec"))), seed)

    # the sets don't wait for each other: a fit is many short jobs
    with ThreadPoolExecutor(AT_ONCE) as pool:
        work = [pool.submit(inheritable_thread_target(scores.sparkSession)(f), *a) for f, a in ((inertia, (data, seed)), *((reference, (b,)) for b in range(n_reference)))]
        own, *logs = (w.result() for w in work)
    mean = sum(logs) / len(logs)
    return mean - own, math.sqrt(1 + 1 / n_reference) * math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs))


def reduced(m: CountMatrix, seed: int = 0) -> DataFrame:
    """(cell_id, vec): log-normalised cells on at most 8 singular vectors."""
    from .factor import truncated_svd

    return stored(truncated_svd(log_norm(m), min(8, max(1, m.n_genes() - 1)), seed)[0])


def select_k(m: CountMatrix, k_min: int = 1, k_max: int = 50, n_reference: int = 5, skip: int = 5, seed: int = 0) -> int:
    """The number of clusters by the gap statistic: a coarse scan in steps of ``skip``, then a fine one around its choice.

    The coarse scan chooses the first k whose gap isn't clearly below the next
    one's, else the last it looks at; the fine one the first k at most ``skip`` off
    whose gap isn't below the next one's by its error, else the last.
    """
    if k_min == k_max:
        return k_min
    scores, seen = reduced(m, seed), {}

    def at(k: int) -> tuple[float, float]:
        if k not in seen:
            seen[k] = gap(scores, k, n_reference, seed)
        return seen[k]

    def first(ks: range, errors: int) -> int:
        for k, after in zip(ks, ks[1:], strict=False):
            if at(k)[0] >= at(after)[0] - errors * at(after)[1]:
                return k
        return ks[-1]

    coarse = first(range(k_min, k_max + 1, skip), skip + 1)
    return coarse if skip == 1 else first(range(max(k_min, coarse - skip), min(coarse + skip, k_max) + 1), 1)


def cluster_overlaps(runs: DataFrame) -> DataFrame:
    """(run, cluster, other_run, other, n): how many cells two clusters of any runs share, each with itself included.

    A cell's labels meet in one row, one for each run; its pairs are added up
    where they are made, so what is shuffled is a row per pair of clusters.
    """
    label = F.struct("run", "cluster")
    rows = runs.groupBy("cell_id").agg(F.collect_list(label).alias("a")).select("a", F.col("a").alias("b"))  # one label per run
    pairs = rows.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select("a.run", "a.cluster", F.col("b.run").alias("other_run"), F.col("b.cluster").alias("other"), "n")


def linked_groups(likeness: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Agglomeration to k groups by mean, least or greatest likeness; the first of equally like pairs first. Groups count by their first member."""
    n = len(likeness)
    near, size, group = likeness.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(near, -np.inf)
    for _ in range(max(0, n - k)):
        i, j = divmod(int(np.argmax(np.round(near, 12))), n)
        i, j = min(i, j), max(i, j)
        if linkage == "mean":
            joined = (near[i] * size[i] + near[j] * size[j]) / (size[i] + size[j])
        else:
            joined = (np.minimum if linkage == "least" else np.maximum)(near[i], near[j])
        near[i], near[:, i] = joined, joined
        near[j], near[:, j], near[i, i] = -np.inf, -np.inf, -np.inf
        size[i] += size[j]
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]


def _mean_nmi(tables: dict, total: float) -> float:
    """The mean over runs of the normalised mutual information of contingency tables {(cluster, label): n}."""
    out = []
    for t in tables.values():
        n = np.array([[t.get((a, b), 0) for b in sorted({k[1] for k in t})] for a in sorted({k[0] for k in t})]) / total
        entropy = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
        a, b, both = entropy(n.sum(1)), entropy(n.sum(0)), entropy(n.ravel())
        out.append(2 * (a + b - both) / (a + b) if a + b > 0 else 1.0)
    return float(np.mean(out))


LINKAGES = ("mean", "least", "greatest")


def consensus(runs: DataFrame, k: int, linkages: tuple[str, ...] = LINKAGES) -> DataFrame:
    """(cell_id, cluster) from several clusterings (run, cell_id, cluster), by meta-clusters.

    The clusters of all runs are the nodes of a graph, weighted by the Jaccard
    index of their cells; k groups of them are made, by each linkage.  A cell
    goes to the group of whose clusters the largest share holds it, ties to the
    first.  Of the groupings that one stays which has the highest mean NMI with
    the runs, the first of equals.  The graph (runs * k clusters squared) alone
    meets on the driver.
    """
    runs = stored(runs.select("run", "cell_id", F.col("cluster").cast("int").alias("cluster")).where("cluster is not null"))
    found = cluster_overlaps(runs).collect()  # one row per pair of clusters
    size = {(r.run, r.cluster): r.n for r in found if (r.run, r.cluster) == (r.other_run, r.other)}
    names = sorted(size)
    place = {c: j for j, c in enumerate(names)}
    likeness = np.zeros((len(names), len(names)))
    for r in found:
        a, b = (r.run, r.cluster), (r.other_run, r.other)
        likeness[place[a], place[b]] = r.n / (size[a] + size[b] - r.n)
    best, labels = -1.0, None
    for linkage in linkages if names else ():
        group = linked_groups(likeness, k, linkage)
        made = stored(_by_share(runs, names, group))
        both = made.withColumnRenamed("cluster", "made").join(runs, "cell_id").groupBy("run", "made", "cluster").agg(F.count("*").alias("n")).collect()  # one row per run and pair of labels
        tables: dict = {}
        for r in both:
            tables.setdefault(r.run, {})[(r.made, r.cluster)] = r.n
        score = round(_mean_nmi(tables, sum(next(iter(tables.values())).values())), 9)
        if score > best:
            best, labels = score, made
    return runs.select("cell_id", "cluster") if labels is None else labels


def _by_share(runs: DataFrame, names: list[tuple[int, int]], group: np.ndarray) -> DataFrame:
    """Each cell's group: the one of whose clusters the largest share holds it."""
    members = np.bincount(group)
    made = runs.sparkSession.createDataFrame([(int(r), int(c), int(g), 1.0 / float(members[g])) for (r, c), g in zip(names, group, strict=True)], "run int, cluster int, group int, part double")
    shares = runs.join(F.broadcast(made), ["run", "cluster"]).groupBy("cell_id", "group").agg(F.sum("part").alias("share"))  # one row per cluster
    return shares.groupBy("cell_id").agg(F.min_by("group", F.struct(-F.round("share", 9), "group")).alias("cluster"))


def _balanced(m: CountMatrix, rounds: int = 1) -> CountMatrix:
    """Values over the root of their gene's and cell's totals; more rounds lead towards equal totals of both."""
    from .prep import cell_totals, gene_totals

    out = m
    for _ in range(rounds):
        genes, cells = gene_totals(out).withColumnRenamed("total", "tg"), cell_totals(out).withColumnRenamed("total", "tc")
        rows = out.entries.join(genes, "gene_id").join(cells, "cell_id").select("gene_id", "cell_id", (F.col("value") / F.sqrt(F.col("tg") * F.col("tc"))).alias("value"))
        out = CountMatrix(stored(rows), m.genes, m.cells)
    return out


def _spectral(m: CountMatrix, k: int, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cells' and genes' places (id, vec) on the singular vectors after the first."""
    from .factor import truncated_svd

    cells, _, _ = truncated_svd(m, n + 1, seed)
    genes, _, _ = truncated_svd(m.T, n + 1, seed)
    cut = lambda df: df.withColumn("vec", F.slice("vec", 2, n))
    return cut(cells), cut(genes.withColumnRenamed("cell_id", "gene_id"))


def bicluster(m: CountMatrix, k: int, k_genes: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Spectral biclustering: (cells (cell_id, cluster), genes (gene_id, cluster)) by k-means of each side's places after balancing."""
    from .factor import kmeans_labels

    cells, genes = _spectral(_balanced(m, 4), k, max(1, min(k, m.n_genes() - 1)), seed)
    by_gene = kmeans_labels(genes.withColumnRenamed("gene_id", "cell_id"), k_genes, seed).withColumnRenamed("cell_id", "gene_id")
    return kmeans_labels(cells, k, seed), by_gene


def cocluster(m: CountMatrix, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Spectral co-clustering: genes and cells are one set of points, each place over the root of its total, in one k-means."""
    from .factor import kmeans_labels
    from .prep import cell_totals, gene_totals

    n = max(1, math.ceil(math.log2(max(2, k))))
    cells, genes = _spectral(_balanced(m), k, n, seed)

    def scaled(places: DataFrame, totals: DataFrame, key: str, side: int) -> DataFrame:
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
        rows = places.join(totals, key).withColumn("length", length)
        # the cell of the joint k-means is twice the id, plus 1 for genes
        return rows.select((F.col(key) * 2 + side).alias("cell_id"), F.transform("vec", lambda v: F.when(F.col("length") > 0, v / F.col("length")).otherwise(0.0)).alias("vec"))

    both = scaled(cells, cell_totals(m), "cell_id", 0).unionByName(scaled(genes, gene_totals(m), "gene_id", 1))
    labels = kmeans_labels(both, k, seed)
    side = lambda s, name: labels.where(F.pmod("cell_id", F.lit(2)) == s).select(((F.col("cell_id") - s) / 2).cast("long").alias(name), "cluster")
    return side(0, "cell_id"), side(1, "gene_id")
