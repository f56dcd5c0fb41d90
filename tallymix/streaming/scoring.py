"""Weights of new cells against fixed means, as a stream of packed cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.factor import FACTOR_BYTES, sweeps


def score_cells(packed: DataFrame, genes: np.ndarray, means: np.ndarray, n_sweeps: int = 100) -> DataFrame:
    """(cell_id, w), summing to 1, of packed cells (cell_id, idx, val); stateless, so it runs on streams as on tables.

    Entries of genes without means are left out.  The means are sent to all
    tasks and must be below FACTOR_BYTES.
    """
    if means.nbytes + genes.nbytes > FACTOR_BYTES:
        raise ValueError("means beyond FACTOR_BYTES: score a table by poisson_estimate_state, which joins them")
    sent = packed.sparkSession.sparkContext.broadcast((genes, means))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        for b in batches:
            lengths, g, v = np.asarray(b.column("idx").value_lengths().fill_null(0)), np.asarray(b.column("idx").flatten()), np.asarray(b.column("val").flatten())
            at = np.minimum(np.searchsorted(ids, g), len(ids) - 1)
            known = ids[at] == g
            size = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[known], minlength=len(lengths))
            even = np.full((len(lengths), m.shape[1]), 1 / m.shape[1])
            w = sweeps(at[known], v[known], np.concatenate([[0], np.cumsum(size)]), m, even.copy(), n_sweeps)
            total = w.sum(1, keepdims=True)
            w = np.where(total > 0, w / np.where(total > 0, total, 1), even)
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array(list(w), pa.list_(pa.float64()))], ["cell_id", "w"])

    return packed.select("cell_id", "idx", "val").mapInArrow(run, "cell_id long, w array<double>")


def start_scoring(stream: DataFrame, genes: np.ndarray, means: np.ndarray, out: str, checkpoint: str, n_sweeps: int = 100):
    """Appends each batch's weights to a Parquet folder; exactly once by the sink's log."""
    return score_cells(stream, genes, means, n_sweeps).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
