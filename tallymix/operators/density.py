"""DBSCAN by squares in which all points are neighbours.

Squares have a diagonal of eps, so a square with ``min_points`` points is core
without looking at a pair, and all core points of one square are one cluster.
Points are dealt by ranges of (square, place) and packed into blocks of some
hundred with their bounding boxes; blocks of squares that can be within eps meet
by a coarse grid.  Only points of sparse squares are counted against others.
Two squares are linked if any of their core points are within eps: by the boxes
alone where these are near enough, else by halving boxes until one pair is
found.  Clusters are the components of linked squares, by star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .neighbours import usable
from .store import shared_folder, small_batches, stored

BLOCK_ROWS = 512
#: Pairs held at a time where boxes don't decide.
LEAF = 64


def any_within(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any point of a is within eps of one of b: boxes that are too far apart fall out, near enough ones decide, others are halved."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        low_a, high_a, low_b, high_b = a.min(0), a.max(0), b.min(0), b.max(0)
        gap = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
        if (gap * gap).sum() > eps * eps * (1 + 1e-9):
            continue
        if len(a) * len(b) <= LEAF * LEAF:
            if (((a[:, None] - b[None]) ** 2).sum(-1) <= eps * eps).any():
                return True
            continue
        far = np.maximum(high_b - low_a, high_a - low_b)
        if (far * far).sum() <= eps * eps * (1 - 1e-9):
            return True
        if len(b) > len(a):
            a, b, low_a, high_a = b, a, low_b, high_b
        side = int(np.argmax(high_a - low_a))
        order = np.argpartition(a[:, side], len(a) // 2)
        todo += [(a[order[len(a) // 2 :]], b), (a[order[: len(a) // 2]], b)]
    return False


def _points(row: dict, name: str, dims: int) -> np.ndarray:
    return np.frombuffer(row[name], np.float64).reshape(-1, dims)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (r for b in batches for r in b.to_pylist())


BLOCKS = "square string, coarse_x long, coarse_y long, block long, n int, least_id long, ids binary, v binary, low array<double>, high array<double>"
_BLOCK = pa.schema([("square", pa.string()), ("coarse_x", pa.int64()), ("coarse_y", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("least_id", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _packed(points: DataFrame, eps: float, dims: int) -> DataFrame:
    from pyspark import TaskContext

    side = eps / np.sqrt(dims) * (1 - 1e-9)
    places = points.withColumn("at", F.transform("v", lambda x: F.floor(x / F.lit(side))))
    corner = lambda j: F.floor(F.element_at("at", j) * F.lit(side) / F.lit(2 * eps))
    keyed = places.select(F.concat_ws(",", F.col("at").cast("array<string>")).alias("square"), corner(1).alias("cx"), (corner(2) if dims > 1 else F.lit(0)).cast("long").alias("cy"), F.element_at("v", 1).alias("x0"), "id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, now = TaskContext.get().partitionId(), 0, [], None

        def made() -> pa.RecordBatch:
            ids, x = np.array([h[3] for h in held], np.int64), np.array([h[4] for h in held], float)
            return pa.RecordBatch.from_pylist([{"square": now, "coarse_x": held[0][1], "coarse_y": held[0][2], "block": (part << 32) + number, "n": len(ids), "least_id": int(ids.min()), "ids": ids.tobytes(), "v": x.tobytes(), "low": x.min(0).tolist(), "high": x.max(0).tolist()}], _BLOCK)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("square", "cx", "cy", "id", "v")), strict=True):
                if held and (row[0] != now or len(held) == BLOCK_ROWS):
                    yield made()
                    number, held = number + 1, []
                now = row[0]
                held.append(row)
        if held:
            yield made()

    return keyed.repartitionByRange("square", "x0", "id").sortWithinPartitions("square", "x0", "id").mapInArrow(pack, BLOCKS)


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(cell_id, cluster) of points (cell_id, vec): -1 is noise (and what has no place), other clusters carry their least core cell_id.

    A point counts among its own neighbours; a border point goes to the least of the clusters that it touches.
    """
    spark = points.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    known = stored(usable(points, "cell_id", "vec"), f"{folder}/points")
    dims = known.agg(F.max(F.size("v"))).first()[0] or 1
    blocks = stored(_packed(known, eps, dims), f"{folder}/blocks")
    sizes = blocks.groupBy("square").agg(F.sum("n").alias("n_square"))
    blocks = stored(blocks.join(sizes, "square").withColumn("dense", F.col("n_square") >= min_points), f"{folder}/sized")
    gap = F.aggregate(F.zip_with(F.zip_with("low_b", "high", lambda x, y: x - y), F.zip_with("low", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    far = F.aggregate(F.zip_with(F.zip_with("high_b", "low", lambda x, y: x - y), F.zip_with("high", "low_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x * x)
    steps = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of blocks whose boxes are within eps; the right one's columns end in _b."""
        other = right.select(*(F.col(c).alias(f"{c}_b") for c in right.columns)).withColumn("step", steps)
        other = other.withColumns({"coarse_x": F.col("coarse_x_b") + F.col("step.x"), "coarse_y": F.col("coarse_y_b") + F.col("step.y")}).drop("step", "coarse_x_b", "coarse_y_b")
        return left.join(other, ["coarse_x", "coarse_y"]).where(gap <= eps * eps * (1 + 1e-9))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = _points(row, "v", dims), _points(row, "v_b", dims)
            near = (((a[:, None] - b[None]) ** 2).sum(-1) <= eps * eps).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(a), pa.int64()), pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(near, pa.int64())], ["block", "id", "n"])

    sparse = blocks.where("not dense")
    counts = met(sparse.select("coarse_x", "coarse_y", "block", "ids", "v", "low", "high"), blocks.select("coarse_x", "coarse_y", "v", "low", "high")).select("block", "ids", "v", "v_b").mapInArrow(count, "block long, id long, n long")
    cores = counts.groupBy("block", "id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).groupBy("block").agg(F.collect_list("id").alias("cores"), F.min("id").alias("least_core"))  # a block's ids at most
    blocks = blocks.join(cores, "block", "left").withColumn("least_core", F.when(F.col("dense"), F.col("least_id")).otherwise(F.col("least_core")))
    blocks = stored(blocks, f"{folder}/cored")
    with_cores = blocks.where("least_core is not null")
    heads = stored(with_cores.groupBy("square").agg(F.min("least_core").alias("head")), f"{folder}/heads")

    def core_points(row: dict, end: str = "") -> np.ndarray:
        x = _points(row, f"v{end}", dims)
        return x if row[f"dense{end}"] else x[np.isin(np.frombuffer(row[f"ids{end}"], np.int64), row[f"cores{end}"])]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if any_within(core_points(row), core_points(row, "_b"), eps):
                yield pa.RecordBatch.from_arrays([pa.array([row["square"]]), pa.array([row["square_b"]])], ["square", "square_b"])

    whole = with_cores.select("coarse_x", "coarse_y", "square", "dense", "low", "high")
    sure = stored(met(whole.where("dense"), whole.where("dense")).where((F.col("square") < F.col("square_b")) & (far <= eps * eps * (1 - 1e-9))).select("square", "square_b").distinct(), f"{folder}/sure")
    asked = with_cores.select("coarse_x", "coarse_y", "square", "dense", "ids", "cores", "v", "low", "high")
    unsure = met(asked, asked).where(F.col("square") < F.col("square_b")).join(sure, ["square", "square_b"], "left_anti").select("square", "square_b", "dense", "dense_b", "ids", "ids_b", "cores", "cores_b", "v", "v_b")
    pairs = sure.union(unsure.mapInArrow(linked, "square string, square_b string")).distinct()
    links = pairs.join(heads.withColumnRenamed("head", "u"), "square").join(heads.select(F.col("square").alias("square_b"), F.col("head").alias("v")), "square_b").select("u", "v")
    made = heads.join(components(links).withColumnRenamed("node", "head"), "head", "left").select("square", F.coalesce("component", "head").alias("cluster"))
    made = stored(made, f"{folder}/clusters")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, a, b = np.frombuffer(row["ids"], np.int64), _points(row, "v", dims), core_points(row, "_b")
            out = ~np.isin(ids, row["cores"] or [])
            near = (((a[out][:, None] - b[None]) ** 2).sum(-1) <= eps * eps).any(1) if out.any() and len(b) else np.zeros(int(out.sum()), bool)
            at = ids[out][near]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([row["square_b"]] * len(at), pa.string())], ["id", "square"])

    touched = met(blocks.where("not dense").select("coarse_x", "coarse_y", "ids", "cores", "v", "low", "high"), asked).select("ids", "cores", "v", "square_b", "dense_b", "ids_b", "cores_b", "v_b").mapInArrow(border, "id long, square string")
    edge = touched.join(made, "square").groupBy("id").agg(F.min("cluster").alias("cluster"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = np.frombuffer(row["ids"], np.int64) if row["dense"] else np.array(row["cores"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row["cluster"]] * len(ids), pa.int64())], ["id", "cluster"])

    inner = with_cores.join(made, "square").select("ids", "cores", "dense", "cluster").mapInArrow(opened, "id long, cluster long")
    return points.select("cell_id").join(inner.union(edge).withColumnRenamed("id", "cell_id"), "cell_id", "left").fillna(-1, ["cluster"])
