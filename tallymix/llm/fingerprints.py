"""Document fingerprints by MinHash.

A fingerprint is ``HASHES`` 16-bit values in hexadecimal: for each of as many
universal hash functions the least value over the text's distinct 5-word
shingles, mixed and cut.  The share of equal values estimates the Jaccard
similarity.  ``near_duplicates`` cuts signatures into bands, joins equal bands
in Spark, and verifies the Jaccard similarity of what meets; the query returns
each document's component of verified links beside its fingerprint.

The query needs each document's next one in descending doc_id.  Documents are
dealt into cells, which are ranges in that order, by boundaries from
approximate percentiles of doc_id, and within a doc_id that takes up several
cells by the first bytes of the text; so cells are alike whatever the ids are.
A task sends each cell its rows in one compressed pack, equal rows as one with
their number.

Edge cases: a null or empty text counts as empty; texts without a word have the
fingerprint of all ones; equal texts have equal fingerprints; repeated rows and
rows of one doc_id follow each other in the order of their texts; a null doc_id
is last in descending order; one document alone is its own next; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, SLICE, U64, Sent, flat_text, mix64, partitions, random_u64, release, set_key, shared_folder, shingles, slices, table
from .jaccard_join import ENTRIES, ENTRY, LEAST, SUBSET, links_of_index, named_components, set_table

HASHES = 64
BANDS, ROWS = 16, 4
#: Bytes of text in a cell, about; bytes that a task gathers before it sends packs.
CELL_BYTES, PACK_BYTES = 16 << 20, 24 << 20
#: Bytes of a text by which rows of one doc_id are dealt.
PREFIX = 7
_FACTORS, _OFFSETS = random_u64(HASHES, 301) | U64(1), random_u64(HASHES, 302)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) 16-bit values; all ones for an empty set."""
    out = np.full((len(sets), HASHES), 0xFFFF, np.uint16)
    use = [k for k, s in enumerate(sets) if len(s)]
    if use:
        x = np.concatenate([sets[k] for k in use])
        at = np.cumsum([0, *(len(sets[k]) for k in use[:-1])])
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                least = np.minimum.reduceat(x * _FACTORS[k] + _OFFSETS[k], at)
                out[use, k] = (mix64(least + U64(k) * GOLDEN) >> U64(48)).astype(np.uint16)
    return out


def signatures_of(texts: list[str | None]) -> np.ndarray:
    return signatures(list(shingles(*flat_text(pa.array(texts, pa.string())))))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def hexadecimal(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint(df: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds each text's fingerprint; a column of that name is replaced."""
    base = df.drop(out)
    schema = base.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, column)):
            made = [hexadecimal(s) for s in signatures(list(shingles(*flat_text(b.column(column)))))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], schema.names)

    return base.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id): texts joined by verified links between sets that agree on a band."""
    folder = shared_folder(docs.sparkSession)
    sets = set_table(docs, folder)
    buckets = max(16, sets.count() * BANDS // ENTRIES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            found = [s for s in shingles(*flat_text(b.column("text"))) if len(s) >= LEAST]
            if not found:
                continue
            values = signatures(found).reshape(len(found), BANDS, ROWS).astype(U64)
            e = np.zeros((len(found), BANDS), ENTRY)
            with np.errstate(over="ignore"):
                band = np.arange(BANDS, dtype=U64) * GOLDEN
                e["key"] = mix64(mix64(values[..., 0] << U64(48) | values[..., 1] << U64(32) | values[..., 2] << U64(16) | values[..., 3]) + band)
            e["id"] = np.array([set_key(s) for s in found])[:, None]
            e["size"], e["pos"] = np.array([len(s) for s in found])[:, None], SUBSET
            e = e.ravel()
            bucket = (mix64(e["key"]) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, e = bucket[order], e[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([e[x:y].tobytes() for x, y in zip(at, np.append(at[1:], len(e)), strict=True)], pa.binary())], ["bucket", "data"])

    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    _, found = links_of_index(docs.mapInArrow(run, "bucket int, data binary"), docs, sets, 0, folder)
    return named_components(sets, found, folder, "set_id")


# --- documents in descending order of doc_id -------------------------------------------------


class Cells:
    """Ranges of (rank of doc_id, prefix of the text); ``ranks`` and ``prefixes`` are where they start, in order."""

    def __init__(self, ranks: np.ndarray, prefixes: np.ndarray):
        self.ranks, self.prefixes = ranks, prefixes
        self.one = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.ranks)

    def of(self, rank: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The last cell that starts at or before each row."""
        low, high = np.searchsorted(self.ranks, rank, "left"), np.searchsorted(self.ranks, rank, "right")
        out = high - 1
        for r in np.unique(rank[high - low > 1]):
            at = np.flatnonzero(rank == r)
            a, b = low[at[0]], high[at[0]]
            out[at] = np.maximum(a, a - 1 + np.searchsorted(self.prefixes[a:b], prefix[at], "right"))
        return out


def rank_of(ids: pa.Array) -> np.ndarray:
    """Unsigned, so that the largest doc_id is first and null last."""
    none = np.asarray(ids.is_null())
    with np.errstate(over="ignore"):
        rank = U64(0x7FFFFFFFFFFFFFFF) - np.asarray(ids.fill_null(0)).astype(np.int64).view(U64)
    return np.where(none, U64(0xFFFFFFFFFFFFFFFF), rank)


def prefix_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The first bytes of each text as a number that sorts like them."""
    out = np.zeros(len(offs) - 1, U64)
    for k in range(PREFIX):
        at = offs[:-1] + k
        inside = at < offs[1:]
        out[inside] |= data[at[inside]].astype(U64) << U64(8 * (PREFIX - 1 - k))
    return out


def cells_of(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> Cells:
    """Boundaries by approximate percentiles; each is a row's own place, so no cell is empty."""
    whole = docs.agg(F.count("doc_id").alias("ids"), F.count("*").alias("rows"), F.max("doc_id").alias("top"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not whole.rows:
        return Cells(np.zeros(0, U64), np.zeros(0, U64))
    wanted = max(partitions(docs.sparkSession), -(-(whole.bytes or 0) // cell_bytes))
    wanted, each = min(wanted, whole.rows), whole.rows / min(wanted, whole.rows)

    def percentiles(n: int) -> list[float]:
        return [k / n for k in range(1, n)]

    n = max(1, round(whole.ids / each))
    values = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(x) for x in percentiles(n))), F.lit(10 * n)).alias("v")).first().v or [] if n > 1 and whole.ids else []
    heavy = sorted({v for k, v in enumerate(values) if v in values[:k]} if len(values) < 64 else {a for a, b in zip(values, values[1:], strict=False) if a == b})
    starts = {(int(v), 0) for v in [*values, *([whole.top] if whole.ids else [])]}
    nulls = whole.rows - whole.ids
    if nulls:
        starts.add((None, 0))
    if heavy or nulls > 2 * each:
        prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("long")
        own = docs.where(F.col("doc_id").isin(heavy) if heavy else F.lit(False)).union(docs.where("doc_id is null"))
        for r in own.groupBy("doc_id").agg(F.percentile_approx(prefix, F.array(*(F.lit(x) for x in percentiles(max(2, wanted)))), F.lit(10 * wanted)).alias("v"), F.min(prefix).alias("first"), F.count("*").alias("n")).collect():
            step = max(1, int(wanted * each / r.n))
            # the first part starts where the doc_id does
            starts |= {(r.doc_id, int(v)) for v in r.v[::step] if v > r.first}
    keys = sorted((0xFFFFFFFFFFFFFFFF if d is None else 0x7FFFFFFFFFFFFFFF - d, p) for d, p in starts)
    return Cells(np.array([k for k, _ in keys], U64), np.array([p for _, p in keys], U64))


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


PACKS = "cell int, kind int, data binary"
ROWS_OF_A_PACK = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64())])


def packed(docs: DataFrame, cells: Cells) -> DataFrame:
    """(cell, kind 0, data): packs of (doc_id, text, n), equal rows of a pack as one."""
    sent = Sent(docs.sparkSession, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0
        for b in (part for batch in batches for part in slices(batch)):
            held.append(b)
            size += b.nbytes
            if size >= PACK_BYTES:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).group_by(["doc_id", "text"]).aggregate([([], "count_all")]).rename_columns(["doc_id", "text", "n"]).cast(ROWS_OF_A_PACK).combine_chunks()
        text = rows.column("text").combine_chunks()
        cell = sent.value.of(rank_of(rows.column("doc_id").combine_chunks()), prefix_of(*flat_text(text)))
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
        packs = [_pack(rows.take(pa.array(order[a:b]))) for a, b in zip(first, np.append(first[1:], len(order)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cell[order][first], pa.int32()), pa.array(np.zeros(len(first)), pa.int32()), pa.array(packs, pa.binary())], ["cell", "kind", "data"])

    return docs.mapInArrow(run, PACKS)


def heads(docs: DataFrame, cells: Cells) -> DataFrame:
    """(cell, kind 1, data): the first row of the next cell, for the last cell that of the first one."""
    spark, n = docs.sparkSession, len(cells)
    ranks = [int(r) for r in cells.ranks]
    starts = [(c, None if r == 0xFFFFFFFFFFFFFFFF else 0x7FFFFFFFFFFFFFFF - r, int(p), ranks[c] == ranks[c - 1] if c else False) for c, (r, p) in enumerate(zip(ranks, cells.prefixes, strict=True))]
    of = spark.createDataFrame(starts, "cell int, start long, prefix long, inner boolean")  # one row per cell
    sent = Sent(spark, cells)
    rows = docs.join(F.broadcast(of), F.col("doc_id").eqNullSafe(F.col("start"))).select("doc_id", "text").distinct()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = sent.value.of(rank_of(b.column("doc_id")), prefix_of(*flat_text(b.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], ["cell", "doc_id", "text"])

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packs = [_pack(pa.table({"doc_id": b.column("doc_id").slice(k, 1), "text": b.column("text").slice(k, 1), "n": pa.array([1], pa.int64())}, schema=ROWS_OF_A_PACK)) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array((np.asarray(b.column("cell")) - 1) % n, pa.int32()), pa.array(np.ones(b.num_rows), pa.int32()), pa.array(packs, pa.binary())], ["cell", "kind", "data"])

    first = rows.mapInArrow(own, "cell int, doc_id long, text string").groupBy("cell").agg(F.min("text").alias("text"), F.max("doc_id").alias("doc_id"))
    return first.select("cell", "doc_id", "text").mapInArrow(wrap, PACKS)


def components_packed(near: DataFrame, cells: Cells) -> DataFrame:
    """(cell, kind 2, data): (doc_id, set_id, component_id) where the component isn't named by the document itself, in all cells of its doc_id."""
    sent = Sent(near.sparkSession, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank, ranks = rank_of(b.column("doc_id")), sent.value.ranks
            low, high = np.searchsorted(ranks, rank, "left"), np.searchsorted(ranks, rank, "right")
            low = np.minimum(low, high - 1)
            row = np.repeat(np.arange(len(rank)), high - low)
            cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
            t = pa.Table.from_batches([b])
            packs = [_pack(t.take(pa.array(row[order[x:y]]))) for x, y in zip(first, np.append(first[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[order][first], pa.int32()), pa.array(np.full(len(first), 2), pa.int32()), pa.array(packs, pa.binary())], ["cell", "kind", "data"])

    other = near.where("set_id is not null and not (doc_id <=> component_id)").select("doc_id", "set_id", "component_id")
    return other.mapInArrow(run, PACKS)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by as many first ones of the text that follows, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def _compared(t: pa.Table) -> pa.Table:
    """One cell's rows, each with its follower."""
    release()
    kind = np.asarray(t.column("kind"))
    packs = lambda k: [_unpack(t.column("data")[i]) for i in np.flatnonzero(kind == k).tolist()]
    found: dict[tuple[int | None, int], int] = {}
    for x in packs(2):
        found.update(zip(zip(x.column("doc_id").to_pylist(), x.column("set_id").to_pylist(), strict=True), x.column("component_id").to_pylist(), strict=True))
    rows = pa.concat_tables(packs(0)).group_by(["doc_id", "text"]).aggregate([("n", "sum")])
    rank = pa.array(rank_of(rows.column("doc_id").combine_chunks()))
    rows = rows.append_column("rank", rank).sort_by([("rank", "ascending"), ("text", "ascending")])
    rows = rows.select(["doc_id", "text", "n_sum"]).rename_columns(["doc_id", "text", "n"]).cast(ROWS_OF_A_PACK)
    rows = pa.concat_tables([rows, packs(1)[0]]).combine_chunks()
    out = []
    ids, number, start = rows.column("doc_id").to_pylist(), np.asarray(rows.column("n")), 0
    _, offs = flat_text(rows.column("text"))
    last = len(ids) - 1
    while start < last:
        end = min(last, max(start + 1, int(np.searchsorted(offs, offs[start] + SLICE, "right")) - 1))
        texts = rows.column("text").slice(start, end - start + 1).to_pylist()
        sets = list(shingles(*flat_text(rows.column("text").slice(start, end - start + 1))))
        sig, n = signatures(sets), end - start
        next_ = [texts[k + 1] for k in range(n)]
        # a row that is there more than once is followed by itself, the last of them by the next
        alone = np.arange(n)
        again = np.flatnonzero(number[start:end] > 1)
        new = [edited(texts[k], next_[k]) for k in range(n)] + [edited(texts[k], texts[k]) for k in again.tolist()]
        esig = signatures_of(new)
        use = np.concatenate([alone, again])
        follower = np.concatenate([alone + 1, again])
        named = [found.get((ids[start + k], set_key(s)), ids[start + k]) if len(s) else ids[start + k] for k, s in enumerate(sets[:n])]
        part = pa.table({
            "doc_id": pa.array([ids[start + k] for k in use], pa.int64()), "n_chars": pa.array([len(texts[k]) for k in use], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), "fingerprint": pa.array([hexadecimal(sig[k]) for k in use], pa.string()),
            "edited_fingerprint": pa.array([hexadecimal(x) for x in esig], pa.string()), "near_edited": pa.array(likeness(sig[use], esig), pa.float64()),
            "near_next": pa.array(likeness(sig[use], sig[follower]), pa.float64()), "component_id": pa.array([named[k] for k in use], pa.int64()),
        })
        times = np.concatenate([np.ones(n, np.int64), number[start:end][again] - 1])
        out.append(part.take(pa.array(np.repeat(np.arange(len(use)), times))) if len(again) else part)
        start = end
    return pa.concat_tables(out)


def with_followers(docs: DataFrame, near: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``RESULT`` for each row of docs; ``near`` is what ``near_duplicates`` gives for them."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    cells = cells_of(docs, cell_bytes)
    if not len(cells):
        return docs.sparkSession.createDataFrame([], RESULT)
    rows = packed(docs, cells).union(heads(docs, cells)).union(components_packed(near, cells))
    return rows.groupBy("cell").applyInArrow(_compared, RESULT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_followers(docs, near_duplicates(docs))
