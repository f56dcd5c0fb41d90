"""Vector code compression: product codebooks on whole numbers, each part's nearest entry found by exponion search.

Components become floor(256 x).  A vector is cut into equal parts; each part
position has a codebook of ``ENTRIES`` entries, which start as that part of the
vectors with the smallest ids.  A round assigns every part to its nearest entry
and moves each entry to the floored mean of its parts.

The search starts at the entry that the part had in the round before.  With u
the distance to it, an entry at most u away from the part is at most 2 u away
from that entry, so only this entry's neighbours inside 2 u are looked at, from
a list that is sorted by distance once per codebook.  Squares are compared as
whole numbers (d^2 <= 4 u^2), so the radius is exact, and equally near entries
go by the lower index.

Rows, their whole numbers and their entries are written to the shared folder
each round.  Tasks add up their own parts by entry, and Spark adds those sums,
which is the same in whatever order; only the codebooks meet on the driver
(parts x entries x their width, whatever the number of vectors).

Edge cases: a vector that is null, empty, not a multiple of ``PARTS`` long, or
holds a null or non-finite component is dropped; so is one whose length differs
from that of the smallest kept id, and one with a component so large (beyond
half a million for 64 of them) that its error needn't fit a long.  Null ids come
after all others; repeated ids are in the order of their components; fewer
vectors than entries make shorter codebooks.  Null labels are one label.  Equal
vectors have equal codes.  Other columns don't pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, shared_folder, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts that are searched at a time.
SEARCHED = 1 << 15
#: Labels with more than one row of so many are joined by broadcast: there are at most so many of them.
HOT_LABELS = 1000
ROW = "vec_id long, label string, dims int, x binary, entries binary"


class Codebook:
    """Entries of each part position (parts, entries, width), and for each entry the others by distance, nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        diff = entries[:, :, None, :] - entries[:, None, :, :]
        square = (diff * diff).sum(-1)
        self.order = np.argsort(square, axis=2, kind="stable")
        self.square = np.take_along_axis(square, self.order, 2)

    def __len__(self) -> int:
        return self.entries.shape[1]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For vectors (n, parts * width) and their entries so far (n, parts): the nearest entries and squared distances."""
        n, parts = start.shape
        best, square = start.astype(np.int64), np.empty((n, parts), np.int64)
        step = max(1, SEARCHED // parts)
        for a in range(0, n, step):
            b = slice(a, a + step)
            best[b], square[b] = self._searched(x[b].reshape(-1, parts, self.entries.shape[2]), best[b])
        return best, square

    def _searched(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, parts, width = x.shape
        part = np.tile(np.arange(parts), n)
        x, own = x.reshape(-1, width), start.reshape(-1)
        diff = x - self.entries[part, own]
        square = (diff * diff).sum(1)
        # neighbours of the own entry inside twice the distance; the own entry is the first or equals it
        within = np.zeros(len(own), np.int64)
        group = part * len(self) + own
        by = np.argsort(group, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            if len(at):
                within[at] = np.searchsorted(self.square[part[at[0]], own[at[0]]], 4 * square[at], "right")
        turn = np.argsort(-within, kind="stable")
        x, part, own, within = x[turn], part[turn], own[turn], within[turn]
        best, least = own.copy(), square[turn]
        for j in range(int(within[0]) if len(within) else 0):
            m = int(np.searchsorted(-within, -j, "left"))  # those with more than j neighbours to look at
            other = self.order[part[:m], own[:m], j]
            diff = x[:m] - self.entries[part[:m], other]
            d = (diff * diff).sum(1)
            nearer = (d < least[:m]) | ((d == least[:m]) & (other < best[:m]))
            best[:m], least[:m] = np.where(nearer, other, best[:m]), np.where(nearer, d, least[:m])
        out, distance = np.empty_like(best), np.empty_like(least)
        out[turn], distance[turn] = best, least
        return out.reshape(n, parts), distance.reshape(n, parts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def most_component(dims: int) -> int:
    """Components below it have squared distances whose sum over a vector fits a long."""
    return math.isqrt(2**62 // dims) // 2


def whole_numbers(vectors: pa.Array, parts: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of the vectors that are kept: positions, floored components as little-endian 32-bit numbers, lengths."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    values = vectors.flatten()
    with np.errstate(over="ignore"):
        x = np.floor(values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float) * SCALE)
    bad = ~np.isfinite(x)
    start = np.cumsum(size) - size
    ok = (size > 0) & (size % parts == 0)
    wrong = np.concatenate(([0], np.cumsum(bad)))
    ok &= wrong[start + size] == wrong[start]
    rows, out = [], []
    for i in np.flatnonzero(ok):
        row = x[start[i] : start[i] + size[i]]
        if np.abs(row).max() < most_component(len(row)):
            rows.append(i)
            out.append(row.astype("<i4").tobytes())
    rows = np.array(rows, np.int64)
    return rows, out, size[rows]


def kept_vectors(df: DataFrame, folder: str, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """The kept rows in whole numbers, stored; every part starts at entry 0."""
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = bytes(parts * 2)
        for b in batches:
            rows, found, dims = whole_numbers(b.column("v"), parts)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), b.column("label").take(at), pa.array(dims, pa.int32()), pa.array(found, pa.binary()), pa.array([zero] * len(found), pa.binary())],
                ["vec_id", "label", "dims", "x", "entries"],
            )

    return stored(base.mapInArrow(run, ROW), folder, "kept")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 1), np.int64)


def assigned(rows: DataFrame, codebook: Codebook, parts: int) -> DataFrame:
    """Rows with each part's nearest entry, and the squared distances' sum as ``error``."""
    sent = Sent(rows.sparkSession, codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                entries, square = sent.value.nearest(_matrix(b.column("x"), "<i4"), _matrix(b.column("entries"), "<u2"))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([e.tobytes() for e in entries.astype("<u2")], pa.binary()), pa.array(square.sum(1), pa.int64())], ["vec_id", "label", "dims", "x", "entries", "error"])

    return rows.select("vec_id", "label", "dims", "x", "entries").mapInArrow(run, f"{ROW}, error long")


def moved(rows: DataFrame, codebook: Codebook, parts: int) -> Codebook:
    """Each entry at the floored mean of its parts; one without parts stays."""
    n, width = len(codebook), codebook.entries.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
        for b in batches:
            at = (_matrix(b.column("entries"), "<u2") + np.arange(parts) * n).reshape(-1) if b.num_rows else np.zeros(0, np.int64)
            count += np.bincount(at, minlength=parts * n)
            x = _matrix(b.column("x"), "<i4").reshape(-1, width) if b.num_rows else np.zeros((0, width), np.int64)
            for d in range(width):
                np.add.at(total[:, d], at, x[:, d])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), *(pa.array(total[used, d], pa.int64()) for d in range(width))], ["slot", "n", *(f"s{d}" for d in range(width))])

    made = rows.select("x", "entries").mapInArrow(sums, "slot long, n long, " + ", ".join(f"s{d} long" for d in range(width)))
    # a decimal holds the sum of any number of rows
    found = made.groupBy("slot").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"s{d}" for d in range(width))))).collect()
    entries = codebook.entries.reshape(parts * n, width).copy()
    for r in found:  # one row per entry
        entries[r.slot] = [int(r[f"s{d}"]) // int(r.n) for d in range(width)]
    return Codebook(entries.reshape(parts, n, width))


def first_codebook(rows: DataFrame, parts: int, entries: int) -> Codebook | None:
    """That of the vectors with the smallest ids; None without a vector."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None
    x = np.stack([np.frombuffer(r.x, "<i4").astype(np.int64) for r in first])
    return Codebook(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook | None]:
    """(vec_id, label, code, error), stored, and the final codebook. Labels come as text."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    rows = kept_vectors(df, folder, id_col, vector_col, label_col, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("dims").head()
    codebook = None
    if first is not None:
        rows = rows.where(F.col("dims") == first.dims)
        codebook = first_codebook(rows, parts, entries)
        for k in range(rounds):
            rows = stored(assigned(rows, codebook, parts), folder, f"round-{k}")
            codebook = moved(rows, codebook, parts)
        rows = assigned(rows, codebook, parts)
    else:
        rows = rows.withColumn("error", F.lit(0).cast("long"))
    return stored(rows.select("vec_id", "label", F.col("entries").alias("code"), "error"), folder, "coded"), codebook


def hex_code(entries: str) -> Column:
    """Two hex digits for each two bytes of little-endian entries below 256."""
    return F.regexp_replace(F.lower(F.hex(entries)), "(..)00", "$1")


def decoded(code: str, codebook: Codebook) -> np.ndarray:
    """The vector that a code of hex digits stands for, in whole numbers."""
    return codebook.entries[np.arange(len(code) // 2), [int(code[k : k + 2], 16) for k in range(0, len(code), 2)]].reshape(-1)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors of all rows of the label.

    A label with more than one row of ``HOT_LABELS`` gets its sum by broadcast,
    since there are fewer of those than that; the others by a join on the label.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_"))
    total = rows.count()
    hot = F.broadcast(sums.where(F.col("n_") * HOT_LABELS > total).select(F.col("label").alias("l_"), "label_error"))
    few = sums.where(F.col("n_") * HOT_LABELS <= total).select(F.col("label").alias("l_"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l_"))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(few, same)).drop("l_")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebook = encode(table(spark, sf_dir, "embeddings"))
    out = with_label_error(rows)
    return out.select("vec_id", hex_code("code").alias("code"), "error", "label_error", F.lit(codebook.digest() if codebook else None).cast("string").alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the codebooks c{k} as a{k}, and the codebooks c{k+1} that follow."""
    return f"""
g{k} AS (
  SELECT v, p, e, sum((x.y - c.y) * (x.y - c.y)) AS d FROM x JOIN c{k} c USING (p, j) GROUP BY v, p, e),
a{k} AS (
  SELECT v, p, arg_min(e, d * 1024 + e) AS e, min(d) AS d FROM g{k} GROUP BY v, p),
m{k} AS (
  SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN x USING (v, p) GROUP BY p, e, j),
c{k + 1} AS (
  SELECT p, e, j, CASE WHEN n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS y FROM c{k} LEFT JOIN m{k} USING (p, e, j))"""


ORACLE_SQL = f"""
WITH r AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND embedding IS NOT NULL),
s AS (SELECT v, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM r),
x AS (SELECT v, i // w AS p, i % w AS j, CAST(floor({SCALE} * CAST(f AS DOUBLE)) AS BIGINT) AS y FROM s),
c0 AS (SELECT p, v AS e, j, y FROM x WHERE v < {ENTRIES}),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
o AS (
  SELECT v, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY v),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN r USING (v), h"""
