"""Passes over a matrix whose longer side carries a state with it, while the shorter side is an array.

The entries are dealt once into bundles: some thousand rows of the longer side,
whole, with places on the shorter side and a state of so many numbers a row.  A
pass sends an array of the shorter side to all tasks; each bundle's kernel makes
the rows' next state and adds to sums over the shorter side, which meet on the
driver by blocks.  A pass reads and writes bundles and shuffles sums only, so
nothing of the longer side's size comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import CountMatrix
from .store import dropped, shared_folder, small_batches, stored

#: Entries and rows of a bundle on average, and places of the shorter side in one block of sums.
BUNDLE_ENTRIES, BUNDLE_ROWS, BLOCK = 1 << 16, 1 << 13, 1 << 13

SCHEMA = "bundle long, ids binary, size binary, idx binary, val binary, state binary, each binary, start long, sum binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.int64() if c.endswith(" long") else pa.binary() for c in SCHEMA.split(", ")]
_VALUES = {1: np.uint8, 4: np.int32, 8: np.float64}


def _value_bytes(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, others as doubles."""
    for kind in (np.uint8, np.int32):
        if not len(x) or (x.min() >= 0 and x.max() <= np.iinfo(kind).max and (x == np.floor(x)).all()):
            return x.astype(kind).tobytes()
    return x.astype(np.float64).tobytes()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], kind) for c, kind in zip(_NAMES, _KINDS, strict=True)], _NAMES)


@dataclass
class Bundle:
    """Rows of the longer side: their ids and states, their entries (places on the shorter side, values) in order, and each entry's row."""

    number: int
    ids: np.ndarray
    size: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    state: np.ndarray
    each: np.ndarray | None = None  # numbers of each entry, if the kernel keeps such

    @classmethod
    def read(cls, row: dict) -> Bundle:
        ids, size, idx = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["size"], np.int32), np.frombuffer(row["idx"], np.int32)
        val = np.frombuffer(row["val"], _VALUES[len(row["val"]) // len(idx)]).astype(float) if len(idx) else np.zeros(0)
        each = None if row["each"] is None else np.frombuffer(row["each"], np.int64).reshape(len(idx), -1 if len(idx) else 0)
        return cls(row["bundle"], ids, size, idx, val, np.frombuffer(row["state"]).reshape(len(ids), -1), each)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.size)

    def row_sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of entries' numbers (entries, n) by row."""
        out, full = np.zeros((len(self.ids), x.shape[1])), np.flatnonzero(self.size)
        if len(full):
            out[full] = np.add.reduceat(x, (np.cumsum(self.size) - self.size)[full], axis=0)
        return out

    def written(self) -> pa.RecordBatch:
        each = None if self.each is None else self.each.astype(np.int64).tobytes()
        return _batch(bundle=self.number, ids=self.ids.tobytes(), size=self.size.astype(np.int32).tobytes(), idx=self.idx.astype(np.int32).tobytes(), val=_value_bytes(self.val), state=self.state.astype(float).tobytes(), each=each)


#: (bundle, held array) to (the bundle with its next state, numbers (entries, n) to add up by place, numbers to add up over all).
Kernel = Callable[[Bundle, np.ndarray], tuple[Bundle, np.ndarray, np.ndarray]]


class Bundles:
    """The bundles of a matrix whose genes are the longer side, with a first state (gene_id, ``array``), and the sorted ids of its cells."""

    def __init__(self, m: CountMatrix, state: DataFrame, array: str, cells: np.ndarray):
        spark = m.cells.sparkSession
        small_batches(spark)
        self.spark, self.cells, self.folder, self.count, self.path = spark, cells, shared_folder(spark), 0, None
        packed = m.packed_genes()
        n = max(1, -(-m.entries.count() // BUNDLE_ENTRIES), -(-m.n_genes() // BUNDLE_ROWS))
        rows = packed.join(state.select("gene_id", F.col(array).cast("array<double>").alias("s")), "gene_id")
        sent = spark.sparkContext.broadcast(cells)

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            flat = lambda c: np.asarray(t.column(c).combine_chunks().flatten())
            gene, size, cell, value = np.asarray(t.column("gene_id")), np.asarray(t.column("idx").combine_chunks().value_lengths()), flat("idx"), flat("val")
            ids, at = np.unique(gene, return_index=True)
            row = np.repeat(np.searchsorted(ids, gene), size)
            place = np.minimum(np.searchsorted(sent.value, cell), max(0, len(sent.value) - 1))
            known = np.flatnonzero(sent.value[place] == cell) if len(sent.value) else np.zeros(0, np.int64)
            known = known[np.lexsort((place[known], row[known]))]
            return pa.Table.from_batches([Bundle(key[0].as_py(), ids, np.bincount(row[known], minlength=len(ids)), place[known], value[known], flat("s").reshape(len(gene), -1)[at]).written()])

        deal = rows.withColumn("bundle", F.pmod(F.xxhash64("gene_id"), F.lit(n)))
        self._keep(deal.groupBy("bundle").applyInArrow(pack, SCHEMA))

    def _keep(self, df: DataFrame) -> None:
        self.count += 1
        path, before = f"{self.folder}/bundles-{self.count}", self.path
        self.rows, self.path = stored(df, path), path
        if before:
            dropped(self.spark, before)

    def advance(self, kernel: Kernel, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes all bundles through the kernel; (sums (cells, n), sums over all)."""
        sent, places = self.spark.sparkContext.broadcast(held), len(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rest = np.zeros((places, n)), None
            for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
                new, add, more = kernel(Bundle.read(row), sent.value)
                for j in range(n):
                    total[:, j] += np.bincount(new.idx, add[:, j], minlength=places)
                rest = more if rest is None else rest + more
                yield new.written()
            if rest is not None:
                yield _batch(start=-1, sum=np.asarray(rest, float).tobytes())
                for a in range(0, places, BLOCK):
                    if total[a : a + BLOCK].any():
                        yield _batch(start=a, sum=total[a : a + BLOCK].tobytes())

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in t.column("sum"))
            return pa.table({"start": t.column("start")[:1], "sum": pa.array([total.tobytes()], pa.binary())})

        self._keep(self.rows.where("bundle is not null").mapInArrow(run, SCHEMA))
        out, rest = np.zeros((places, n)), np.zeros(0)
        for r in self.rows.where("start is not null").select("start", "sum").groupBy("start").applyInArrow(add, "start long, sum binary").collect():  # one row per block of the shorter side
            if r.start < 0:
                rest = np.frombuffer(r["sum"])
            else:
                out[r.start : r.start + BLOCK] = np.frombuffer(r["sum"]).reshape(-1, n)
        sent.unpersist()
        return out, rest

    def states(self, name: str, first: int = 0, last: int | None = None) -> DataFrame:
        """(gene_id, name): the rows' states, or some of their numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.ascontiguousarray(np.frombuffer(row["state"]).reshape(len(ids), -1)[:, first:last])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["gene_id", name])

        return self.rows.where("bundle is not null").select("ids", "state").mapInArrow(run, f"gene_id long, {name} array<double>")
