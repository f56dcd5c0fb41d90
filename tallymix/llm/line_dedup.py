"""Line deduplication that can be undone: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased; it
stands as two 64-bit hashes.  ``LineIndex`` keeps, in the shared folder, the
exact table (h1, h2, refs, keeper): in how many documents (rows) a key of at
least ``MIN_CHARS`` code points is, and the largest doc_id among them.  Keys
with ``MIN_DOCS`` references are also entered in cuckoo filters, one per shard
of the keys.  The filters only spare looking up lines that nobody repeats; what
they let through is looked up in the exact table, so false positives cost time
and nothing else.  Beyond ``FILTER_BYTES`` they aren't sent to the executors
and all lines are looked up.

``insert`` and ``delete`` add or take away documents' references: counts are
exact in both directions; where the keeper goes, the next is looked for among
the documents that remain; the filters get and lose the keys that cross
``MIN_DOCS``.

A line in a third of all documents is no group anywhere: tasks count their own
lines first, counts are summed with map-side aggregation, and the look-up joins
rows with a table of one row per key, which adaptive execution splits.

Edge cases: null or empty text is one empty line; each row counts as a document,
and all rows with the largest doc_id keep their lines; a null doc_id is below
all others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, GOLDEN, SEGMENT, U64, flat_text, is_space, mix64, partitions, random_u64, release, shared_folder, slices, stored, table

MIN_CHARS, MIN_DOCS = 20, 3
SHARDS = 64
FILTER_BYTES = 64 << 20
SLOTS, KICKS = 4, 500
#: Keys gathered by a task before it counts them again.
MERGE_KEYS = 1 << 19

_VALUES = [random_u64(256, s) | U64(1) for s in (101, 202)]
for _v in _VALUES:
    _v[65:91] = _v[97:123]


def line_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with long enough keys: index of the text, start, end (without the newline), h1, h2.  Also all line counts by text."""
    breaks = np.flatnonzero(data == 10)
    in_text = np.searchsorted(offs, breaks, "right") - 1
    n_lines = np.bincount(in_text, minlength=len(offs) - 1) + 1
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    text = np.repeat(np.arange(len(offs) - 1), n_lines)
    end = np.append(start[1:] - 1, len(data))
    last = np.cumsum(n_lines) - 1
    end[last] = offs[1:]
    solid = np.flatnonzero(~is_space(data))
    if not len(solid):
        none = np.zeros(0, np.int64)
        return n_lines, none, none, none, none.astype(U64), none.astype(U64)
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, end)
    points = np.concatenate([np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    a = solid[np.minimum(lo, len(solid) - 1)]
    b = solid[np.maximum(hi - 1, 0)] + 1
    use = np.flatnonzero((hi > lo) & (points[np.maximum(b, a)] - points[a] >= MIN_CHARS))
    a, b = a[use], b[use]
    h1, h2 = _range_hashes(data, a, b)
    return n_lines, text[use], start[use], end[use], h1, h2


def _range_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes in each of the ascending, disjoint ranges."""
    out = [np.zeros(len(a), U64), np.zeros(len(a), U64)]
    size, k = b - a, 0
    total = np.cumsum(size)
    with np.errstate(over="ignore"):
        while k < len(a):
            m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SEGMENT)))
            n = size[k:m]
            at = np.cumsum(n) - n
            pos = np.arange(int(n.sum())) - np.repeat(at, n)
            bytes_ = data[np.repeat(a[k:m], n) + pos]
            powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(int(n.max()), _BASE)]))[pos]
            for o, v in zip(out, _VALUES, strict=True):
                o[k:m] = mix64(np.add.reduceat(v[bytes_] * powers, at) + n.astype(U64) * GOLDEN)
            k = m
    return out[0], out[1]


def _unique(h1: np.ndarray, h2: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (h1, h2, more...) together, and where runs of equal (h1, h2) start."""
    order = np.lexsort((*more, h2, h1))
    x, y = h1[order], h2[order]
    return order, np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)


LOW = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(LOW))


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of this partition: its documents counted, and their largest id."""
    release()
    parts: list[tuple[np.ndarray, ...]] = []
    since = 0

    def merged() -> tuple[np.ndarray, ...]:
        h1, h2, n, top = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, at = _unique(h1, h2)
        return h1[order][at], h2[order][at], np.add.reduceat(n[order], at), np.maximum.reduceat(top[order], at)

    for b in (part for batch in batches for part in slices(batch)):
        _, text, _, _, h1, h2 = line_keys(*flat_text(b.column(1)))
        if not len(text):
            continue
        order = np.lexsort((h2, h1, text))
        t, x, y = text[order], h1[order], h2[order]
        first = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        parts.append((x[first], y[first], np.ones(int(first.sum()), np.int64), _ids(b.column(0))[t[first]]))
        since += len(parts[-1][0])
        if since >= MERGE_KEYS:
            parts, since = [merged()], 0
    if parts:
        h1, h2, n, top = merged()
        for k in range(0, len(n), 50_000):
            s = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(n[s]), pa.array(top[s])], ["h1", "h2", "refs", "keeper"])


def references(docs: DataFrame) -> DataFrame:
    """(h1, h2, refs, keeper) of all keys; a null doc_id counts as the least integer."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_references, "h1 long, h2 long, refs long, keeper long")
    return rows.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.max("keeper").alias("keeper"))


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; it doubles when a key finds no place.

    The keys are at hand in the exact table, so growing enters them anew.
    """

    def __init__(self, keys: np.ndarray | None = None, table: np.ndarray | None = None, least: int = 16):
        self.table = np.zeros((least, SLOTS), np.uint16) if table is None else table.copy()
        if keys is not None:
            self.build(keys)

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        f = (keys >> U64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = self.prints(keys)
        mask = U64(len(self.table) - 1)
        one = (mix64(keys) & mask).astype(np.int64)
        return f, one, one ^ self.other(f)

    def other(self, f: np.ndarray) -> np.ndarray:
        return (mix64(np.asarray(f).astype(U64) * GOLDEN) & U64(len(self.table) - 1)).astype(np.int64)

    def build(self, keys: np.ndarray) -> None:
        size = len(self.table)
        while size * SLOTS * 0.9 < len(keys):
            size *= 2
        while True:
            self.table = np.zeros((size, SLOTS), np.uint16)
            if all(self._put(*x) for x in zip(*self.places(keys), strict=True)):
                return
            size *= 2

    def _put(self, f, one, two) -> bool:
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        at = two
        for k in range(KICKS):
            slot = k % SLOTS
            f, self.table[at, slot] = self.table[at, slot], f
            at = int(at ^ self.other(np.array([f]))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        return False

    def insert(self, keys: np.ndarray, all_keys) -> None:
        """``all_keys`` gives what the filter must hold, if it has to grow."""
        for x in zip(*self.places(keys), strict=True):
            if not self._put(*x):
                self.table = np.zeros((2 * len(self.table), SLOTS), np.uint16)
                self.build(all_keys())
                return

    def delete(self, keys: np.ndarray) -> None:
        for f, one, two in zip(*self.places(keys), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == f)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def has(self, keys: np.ndarray) -> np.ndarray:
        f, one, two = self.places(keys)
        return (self.table[one] == f[:, None]).any(1) | (self.table[two] == f[:, None]).any(1)

    def packed(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def of(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS))


def shard_of(h1: np.ndarray) -> np.ndarray:
    return (h1 % U64(SHARDS)).astype(np.int64)


def _shard_column():
    return F.expr(f"cast(pmod(cast(pmod(h1, {SHARDS}) as int), {SHARDS}) as int)")


FILTERS = "shard int, piece int, pieces int, filter binary"


def filter_pieces(spark: SparkSession) -> int:
    return max(1, partitions(spark) // SHARDS)


def build_filters(repeated: DataFrame) -> DataFrame:
    """(shard, piece, pieces, filter) over the keys (h1, h2); a shard's keys are built in pieces, so a task holds no whole shard.

    Each row names the number of pieces that keys are dealt by: pieces without a key have no row.
    """
    pieces = filter_pieces(repeated.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        keys = np.asarray(t.column("h1")).view(U64) ^ np.asarray(t.column("h2")).view(U64)
        return pa.table({"shard": t.column("shard")[:1], "piece": t.column("piece")[:1], "pieces": pa.array([pieces], pa.int32()), "filter": pa.array([Cuckoo(keys).packed()], pa.binary())})

    keyed = repeated.select("h1", "h2", _shard_column().alias("shard"), F.expr(f"cast(pmod(h2, {pieces}) as int)").alias("piece"))
    return keyed.groupBy("shard", "piece").applyInArrow(run, FILTERS)


class LineIndex:
    """Reference counts and filters of a corpus's lines, in a folder shared by driver and executors."""

    def __init__(self, counts: DataFrame, filters: DataFrame, folder: str):
        self.counts, self.filters, self.folder = counts, filters, folder

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        folder = shared_folder(docs.sparkSession)
        counts = stored(references(docs), folder, "counts")
        return cls(counts, stored(build_filters(counts.where(f"refs >= {MIN_DOCS}")), folder, "filters"), folder)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(references(docs), 1, None)

    def delete(self, docs: DataFrame, remaining: DataFrame) -> LineIndex:
        """Takes the rows of ``docs`` away; ``remaining`` are the documents left."""
        return self._changed(references(docs), -1, remaining)

    def _changed(self, delta: DataFrame, sign: int, remaining: DataFrame | None) -> LineIndex:
        folder = shared_folder(delta.sparkSession)
        delta = stored(delta.select("h1", "h2", F.col("refs").alias("d_refs"), F.col("keeper").alias("d_keeper")), folder, "delta")
        both = self.counts.join(delta, ["h1", "h2"], "full")
        refs = F.coalesce("refs", F.lit(0)) + sign * F.coalesce("d_refs", F.lit(0))
        if sign > 0:
            after = both.select("h1", "h2", refs.alias("refs"), F.greatest("keeper", "d_keeper").alias("keeper"), F.coalesce("refs", F.lit(0)).alias("before"))
        else:
            lost = both.where((F.col("keeper") == F.col("d_keeper")) & (refs > 0)).select("h1", "h2")
            again = references(remaining).join(lost, ["h1", "h2"], "left_semi").select("h1", "h2", F.col("keeper").alias("next"))
            after = both.join(again, ["h1", "h2"], "left").select("h1", "h2", refs.alias("refs"), F.coalesce("next", "keeper").alias("keeper"), F.coalesce("refs", F.lit(0)).alias("before"))
        after = stored(after, folder, "after")
        crossed = after.where(f"(refs >= {MIN_DOCS}) <> (before >= {MIN_DOCS})").select("h1", "h2", F.expr(f"refs >= {MIN_DOCS}").alias("enters"))
        counts = after.where("refs > 0").select("h1", "h2", "refs", "keeper")
        pieces = filter_pieces(delta.sparkSession)
        place = lambda d: d.withColumns({"shard": _shard_column(), "piece": F.expr(f"cast(pmod(h2, {pieces}) as int)")})
        if self.filters.agg(F.max("pieces")).first()[0] not in (None, pieces):
            return LineIndex(stored(counts, folder, "counts"), stored(build_filters(counts.where(f"refs >= {MIN_DOCS}")), folder, "filters"), folder)
        holds = place(counts.where(f"refs >= {MIN_DOCS}").select("h1", "h2"))

        def run(f: pa.Table, c: pa.Table) -> pa.Table:
            keys = lambda t: np.asarray(t.column("h1")).view(U64) ^ np.asarray(t.column("h2")).view(U64)
            where = f if f.num_rows else c
            cuckoo = Cuckoo.of(f.column("filter")[0].as_py()) if f.num_rows else Cuckoo()
            enters = np.asarray(c.column("enters")) if c.num_rows else np.zeros(0, bool)
            moved, held = np.asarray(c.column("moved")) if c.num_rows else np.zeros(0, bool), keys(c) if c.num_rows else np.zeros(0, U64)
            cuckoo.delete(held[moved & ~enters])
            cuckoo.insert(held[moved & enters], lambda: held[enters])
            return pa.table({"shard": where.column("shard")[:1].cast(pa.int32()), "piece": where.column("piece")[:1].cast(pa.int32()), "pieces": pa.array([pieces], pa.int32()), "filter": pa.array([cuckoo.packed()], pa.binary())})

        marked = holds.join(crossed.select("h1", "h2", "enters"), ["h1", "h2"], "left").select("h1", "h2", "shard", "piece", F.lit(True).alias("enters"), F.col("enters").isNotNull().alias("moved"))
        leaves = place(crossed.where("not enters")).select("h1", "h2", "shard", "piece", "enters", F.lit(True).alias("moved"))
        filters = self.filters.groupBy("shard", "piece").cogroup(marked.union(leaves).groupBy("shard", "piece")).applyInArrow(run, FILTERS)
        return LineIndex(stored(counts, folder, "counts"), stored(filters, folder, "filters"), folder)

    def _sent(self):
        """The filters, broadcast if they are small; else None."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if size > FILTER_BYTES:
            return None
        rows = self.filters.collect()
        return self.filters.sparkSession.sparkContext.broadcast({(r.shard, r.piece): bytes(r.filter) for r in rows} | {"pieces": max((r.pieces for r in rows), default=1)})

    def dropped_keys(self, docs: DataFrame) -> DataFrame:
        """(id, row, keys): for each doc_id and hash of its text the keys whose lines it loses; keys are (h1, h2)."""
        sent = self._sent()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = None if sent is None else {k: Cuckoo.of(v) for k, v in sent.value.items() if k != "pieces"}
            for b in (part for batch in batches for part in slices(batch)):
                _, text, _, _, h1, h2 = line_keys(*flat_text(b.column(1)))
                keep = np.ones(len(text), bool)
                if filters is not None and len(text):
                    keep[:] = False
                    shard, piece = np.mod(h1.view(np.int64), SHARDS), np.mod(h2.view(np.int64), sent.value["pieces"])
                    for s, p in {*zip(shard.tolist(), piece.tolist(), strict=True)}:
                        if (s, p) in filters:
                            at = np.flatnonzero((shard == s) & (piece == p))
                            keep[at] = filters[s, p].has(h1[at] ^ h2[at])
                text, h1, h2 = text[keep], h1[keep], h2[keep]
                order = np.lexsort((h2, h1, text))
                t, x, y = text[order], h1[order], h2[order]
                first = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(t) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(_ids(b.column(0))[t[first]]), pa.array(np.asarray(b.column(2))[t[first]]), pa.array(x[first].view(np.int64)), pa.array(y[first].view(np.int64))], ["id", "row", "h1", "h2"])

        lines = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) row").mapInArrow(run, "id long, row long, h1 long, h2 long")
        lost = lines.join(self.counts.where(f"refs >= {MIN_DOCS}"), ["h1", "h2"]).where("id <> keeper")
        return lost.groupBy("id", "row").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))


def _kept(text: bytes | None, keys) -> tuple[bytes, int, int]:
    """The text that is left, its lines before, and the lines dropped."""
    text = text or b""
    lines = text.split(b"\n")
    if not keys:
        return text, len(lines), 0
    gone = {(k["h1"], k["h2"]) for k in keys}
    data = np.frombuffer(text, np.uint8)
    _, _, start, _, h1, h2 = line_keys(data, np.array([0, len(data)]))
    drop = {int(s) for s, x, y in zip(start, h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True) if (x, y) in gone}
    left, at = [], 0
    for line in lines:
        if at not in drop:
            left.append(line)
        at += len(line) + 1
    return b"\n".join(left), len(lines), len(lines) - len(left)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The documents without the lines they lose, other columns as they were, plus n_lines and n_dropped."""
    index = index or LineIndex.build(docs)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keys_")]
    lost = index.dropped_keys(docs).select(F.col("id").alias("id_"), F.col("row").alias("row_"), F.col("keys").alias("keys_"))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    joined = docs.select(*columns).join(lost, (ids == F.col("id_")) & (F.xxhash64("text") == F.col("row_")), "left").select(*columns, "keys_")
    schema = joined.drop("keys_").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            got = [_kept(t.as_py(), k) for t, k in zip(b.column("text").cast(pa.binary()), b.column("keys_").to_pylist(), strict=True)]
            text = pa.array([g[0] for g in got], pa.binary()).cast(b.column("text").type)
            made = {"text": text, "n_lines": pa.array([g[1] for g in got], pa.int64()), "n_dropped": pa.array([g[2] for g in got], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name) for f in schema.fields], [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM r),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM x),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
d AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY rid, doc_id"""
