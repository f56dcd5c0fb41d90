"""N-gram Jaccard join: which texts share three quarters of their 5-word shingles, exactly.

The join is size-aware.  Sets up to a boundary size are *small*: two of them
that are near share at least two shingles among the first few of each in one
global order, so each small set enumerates the 2-subsets of these, and equal
subsets meet.  Pairs with a *large* set meet on inverted lists of single
shingles, again only of each set's first ones.  The boundary is where
enumerating gets dearer than scanning, by the sizes and list lengths of the
corpus.  The global order puts frequent shingles last.  Two tables hold, by hash,
the order of magnitude of document counts over all documents: one of shingles,
one of words, since a shingle is in no more documents than the rarest of its
words.  A shingle's level is the lesser of the two.  The tables' sizes are
bounded; where shingles fill the first one, as on a very large corpus, words,
which are far fewer, still tell rare from frequent.  Collisions may cost time,
never a pair: any order that all sets share is right, and a slot that says "in
one set only" is never wrong.

Equal sets are one node from the start.  Short lists give all their pairs.
Long ones (groups of near copies) give pairs with a few pivots; after the
links found so far are joined to components, only pairs of a long list whose
components still differ are tried, in blocks that verify them in place and hand
on no more links than join components, so no component is missed and no group is
ever expanded into all of its pairs.  Lists of
very frequent shingles are dealt over many cells by the sets' hashes.

Shingles are 64-bit hashes, and a set is known by 64 bits of its shingles.

Edge cases: null, empty or blank texts have no shingle and link with nothing;
under five words, the whole sequence is one shingle; repeated rows and equal
texts share a component; null doc_ids never name a component unless they are
alone in it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Sent, components, flat_text, mix64, partitions, release, set_key, shared_folder, shingles, shingles_of, slices, stored, table, words_of

#: Linked from 75 of 100.
SHARE = 75
#: Sets below it can only link with equal ones.
LEAST = 3
#: Largest size that may count as small.
SMALL_MOST = 64
#: The table of levels has 2^bits slots of a byte, about as many as shingles, within these limits.
LEAST_BITS, MOST_BITS = 16, 24
#: The same for words, by the number of shingles over 2^WORD_SHARE.
WORD_SHARE, MOST_WORD_BITS = 3, 22
#: Lists up to this length give all their pairs.
SHORT = 12
PIVOTS = 8
#: log2 of the document count from which a shingle's list is dealt over cells, and of a cell's rows.  Cell 0 is a list that isn't dealt.
CELL_LEVEL = 14
#: Bytes of shingles on either side of a block of sets that are held against each other.
BLOCK_BYTES = 2 << 20
ENTRIES = 200_000
#: Up to so many (doc_id, set_id), 16 bytes each, are broadcast.
SENT_ROWS = 500_000
FLUSH = 1_000_000
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("size", "<u4"), ("pos", "<u2"), ("cell", "<u2")])
SUBSET = 65535


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release()
    for batch in batches:
        for b in slices(batch):
            yield b, list(shingles(*flat_text(b.column("text"))))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "set_id"])


def _distinct_sets(batches: Iterator[pa.RecordBatch], levels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Each set of the partition that may link with another, once: its key, shingles and, for each of these, its rarest word's level by that table; without a table the words instead."""
    seen: set[int] = set()
    release()
    for batch in batches:
        for b in slices(batch):
            h, wo = words_of(*flat_text(b.column("text")))
            own = None if levels is None else levels[slot_of(h, levels)]
            for i, (s, low) in enumerate(shingles_of(h, wo, own)):
                if len(s) >= LEAST and (k := set_key(s)) not in seen:
                    seen.add(k)
                    yield k, s, np.unique(h[wo[i] : wo[i + 1]]) if levels is None else low


def slot_of(hashes: np.ndarray, table_of_levels: np.ndarray) -> np.ndarray:
    return (hashes >> U64(65 - len(table_of_levels).bit_length())).astype(np.int64)


def needed(size):
    """The least overlap with any set that a set of this size can link with."""
    return -(-SHARE * size // 100)


# --- document counts -------------------------------------------------------------------------


def _pack(sorted_values: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences by byte plane, which compress, then counts."""
    step = np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4")
    return np.concatenate([step.view(np.uint8).reshape(-1, 4).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(2, 4, -1)
    step, counts = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
    return np.cumsum(step, dtype=np.uint32), counts


def document_levels(docs: DataFrame, shingles_in_all: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For each slot the largest log2 of its shingles' document counts, the same for words, and the mean length of a shingle's list up to SHORT.

    0 says that nothing of the slot is in two sets.  Tasks count their own
    sets first; what they send is packed by ranges of the hash.
    """
    bits = max(4, min(12, (partitions(docs.sparkSession) - 1).bit_length()))
    size_bits = max(1, shingles_in_all).bit_length() - 1
    slot_bits = max(LEAST_BITS, min(MOST_BITS, size_bits))
    word_bits = max(LEAST_BITS, min(MOST_WORD_BITS, size_bits - WORD_SHARE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts in enumerate(held):
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                at = np.searchsorted(values, np.arange(0, (1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
                rows += [((kind << bits) + k, _pack(values[a:b], n[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

        size = 0
        for _, s, words in _distinct_sets(batches):
            for part, x in zip(held, (s, words), strict=True):
                part.append((x >> U64(32)).astype(np.uint32))
            size += len(s)
            if size >= FLUSH:
                size = 0
                yield flush()
        if held[0]:
            yield flush()

    def total(t: pa.Table) -> pa.Table:
        values, n = (np.concatenate(x) for x in zip(*(_unpack(d.as_py()) for d in t.column("data")), strict=True))
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sums = np.add.reduceat(n[order].astype(np.int64), first)
        words = t.column("bucket")[0].as_py() >> bits
        own_bits = word_bits if words else slot_bits
        shared, light = sums > 1, sums[sums <= SHORT].astype(float) * (not words)
        levels = np.zeros(1 << (own_bits - bits), np.uint8)
        np.maximum.at(levels, (values[first][shared] >> np.uint32(32 - own_bits)) & np.uint32(len(levels) - 1), np.log2(sums[shared]).astype(np.uint8))
        return pa.table({"bucket": t.column("bucket")[:1], "levels": [zlib.compress(levels.tobytes(), 1)], "n": [float(light.sum())], "n2": [float((light**2).sum())]}, schema=pa.schema([("bucket", pa.int32()), ("levels", pa.binary()), ("n", pa.float64()), ("n2", pa.float64())]))

    rows = docs.select("doc_id", "text").mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInArrow(total, "bucket int, levels binary, n double, n2 double").collect()
    out = [np.zeros((1 << bits, 1 << (own - bits)), np.uint8) for own in (slot_bits, word_bits)]
    for r in rows:
        out[r.bucket >> bits][r.bucket & ((1 << bits) - 1)] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    n = sum(r.n for r in rows)
    return out[0].ravel(), out[1].ravel(), sum(r.n2 for r in rows) / n if n else 1.0


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size at which enumerating 2-subsets costs less in all than scanning lists; ``sizes`` counts sets up to SMALL_MOST."""
    best, least, gain = LEAST - 1, 0.0, 0.0
    for size in range(LEAST, SMALL_MOST + 1):
        spare = size - needed(size)
        gain += sizes.get(size, 0) * ((spare + 2) * (spare + 1) / 2 - (spare + 1) * (1 + list_length))
        if gain <= least:
            best, least = size, gain
    return best


# --- candidates ------------------------------------------------------------------------------


def entries_of(key: int, s: np.ndarray, levels: np.ndarray, small: int, rarest: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """What one set enters into the index: subsets if small, single shingles if a large set may look for it.

    ``rarest`` is the level of each shingle's rarest word.  Shingles that are in
    no other set keep their place in the order, but aren't entered.
    """
    level = levels[slot_of(s, levels)]
    if rarest is not None:
        level = np.minimum(level, rarest)
    if level.any():
        order = np.argsort(level, kind="stable")
        s, level = s[order], level[order]
    n, spare = len(s), len(s) - needed(len(s))
    if n <= small:
        i, j = np.triu_indices(spare + 2, 1)
        met = (level[i] > 0) & (level[j] > 0)
        i, j = i[met], j[met]
        out = np.zeros(len(i), ENTRY)
        with np.errstate(over="ignore"):
            out["key"] = mix64(mix64(s[i]) + s[j] * GOLDEN)
        out["id"], out["size"], out["pos"] = key, n, SUBSET
        yield out
    if n >= needed(small + 1):
        p = np.flatnonzero(level[: spare + 1])
        out = np.zeros(len(p), ENTRY)
        out["key"], out["id"], out["size"], out["pos"] = s[p], key, n, np.minimum(p, SUBSET - 1)
        hot = level[p] >= CELL_LEVEL
        if hot.any():
            cells = np.minimum(1 << (level[p][hot].astype(np.int64) - CELL_LEVEL + 1), (1 << 16) - 1)
            out["cell"][hot] = 1 + int(mix64(np.array([key], np.int64).view(U64))[0] >> U64(40)) % cells
        yield out


def index_entries(docs: DataFrame, levels: Sent, small: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            e = np.concatenate(held)
            held.clear()
            with np.errstate(over="ignore"):
                b = (mix64(e["key"] + e["cell"].astype(U64) * GOLDEN) % U64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            b, e = b[order], e[order]
            at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ends = np.append(at[1:], len(b))
            return pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array([e[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary())], ["bucket", "data"])

        size, (of_shingles, of_words) = 0, levels.value
        for key, s, rarest in _distinct_sets(batches, of_words):
            for e in entries_of(key, s, of_shingles, small, rarest):
                if len(e):
                    held.append(e)
                    size += len(e)
            if size >= FLUSH:
                size = 0
                yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, data binary")


def may_link(x: np.ndarray, y: np.ndarray, small: int) -> np.ndarray:
    """By size and place in the order, whether entries of one list can be of linked sets that this list is in charge of."""
    sx, sy = x["size"].astype(np.int64), y["size"].astype(np.int64)
    subset = x["pos"] == SUBSET
    rest = 1 + np.minimum(sx - x["pos"] - 1, sy - y["pos"] - 1)
    # overlap / (sx + sy - overlap) reaches SHARE / 100
    enough = rest >= -(-SHARE * (sx + sy) // (100 + SHARE))
    return (x["id"] != y["id"]) & (100 * np.minimum(sx, sy) >= SHARE * np.maximum(sx, sy)) & (subset | (enough & (np.maximum(sx, sy) > small)))


def _pairs_of(e: np.ndarray, i: np.ndarray, j: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    ok = may_link(e[i], e[j], small)
    a, b = e["id"][i[ok]], e["id"][j[ok]]
    return np.minimum(a, b), np.maximum(a, b)


def candidates(t: pa.Table, small: int) -> pa.Table:
    """The pairs of one bucket's lists (kind 0), and its long lists and all cells of dealt ones (kind 1).

    A cell knows nothing of the key's other cells, so even one entry of it is handed on.
    """
    e = np.concatenate([np.frombuffer(d.as_py(), ENTRY) for d in t.column("data")])
    e = e[np.lexsort((e["id"], e["cell"], e["key"]))]
    same = (e["key"][1:] == e["key"][:-1]) & (e["cell"][1:] == e["cell"][:-1])
    e = e[np.concatenate([[True], ~(same & (e["id"][1:] == e["id"][:-1]))])]
    at = np.flatnonzero(np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["cell"][1:] != e["cell"][:-1])]))
    length = np.diff(np.append(at, len(e)))
    left, right, where = [], [], np.repeat(np.arange(len(at)), length)
    brief = length[where] <= SHORT
    for d in range(1, SHORT):
        i = np.flatnonzero(brief[:-d] & (where[d:] == where[:-d])) if len(e) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        a, b = _pairs_of(e, i, i + d, small)
        left.append(a)
        right.append(b)
    long = np.flatnonzero(length > SHORT)
    for k in long:
        for p in range(PIVOTS):
            j = np.arange(at[k] + p + 1, at[k] + length[k])
            a, b = _pairs_of(e, np.full(len(j), at[k] + p), j, small)
            left.append(a)
            right.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if len(a):
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[new], b[new]
    lists = [e[at[k] : at[k] + length[k]] for k in np.flatnonzero((length > SHORT) | (e["cell"][at] > 0))]
    n = len(a)
    return pa.table({
        "kind": pa.array(np.concatenate([np.zeros(n, np.int32), np.ones(len(lists), np.int32)])),
        "a": pa.array(np.concatenate([a, np.array([x["id"][0] for x in lists], np.int64)])),
        "b": pa.array(np.concatenate([b, np.array([x["size"][0] for x in lists], np.int64)])),
        "key": pa.array(np.concatenate([np.zeros(n, np.int64), np.array([x["key"][0] for x in lists], U64).view(np.int64)])),
        "list": pa.array([None] * n + [x.tobytes() for x in lists], pa.binary()),
    })


# --- verification ----------------------------------------------------------------------------


def token_table(docs: DataFrame, sets: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """(set_id, tokens) for the wanted ids: the shingles of one document of each, once for each task that reads a row of it."""
    first = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    wanted = first.join(ids, "set_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b, found in _sets(batches):
            rows = [(k, s.tobytes()) for k, s in zip(b.column("set_id").to_pylist(), found, strict=True) if len(s) and set_key(s) == k and not (k in seen or seen.add(k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["set_id", "tokens"])

    # texts stay where they are as long as the wanted rows are few enough to be sent; beyond that they are dealt by doc_id
    wanted = stored(wanted, folder, "wanted")
    few = wanted.count() <= SENT_ROWS
    texts = docs.select(F.col("doc_id").alias("d_"), "text").join(F.broadcast(wanted) if few else wanted, F.col("d_").eqNullSafe(F.col("first_id"))).select("text", "set_id")
    return texts.mapInArrow(run, "set_id long, tokens binary")


def verified(pairs: DataFrame, tokens: DataFrame, share: int = SHARE) -> DataFrame:
    """Of pairs (a, b) of set ids those that link, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column("ta"), b.column("tb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * n >= share * (len(both) - n):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))], ["u", "v"])

    ta = tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    tb = tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def _unlisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, data in zip(b.column("key").to_pylist(), b.column("list").to_pylist(), strict=True):
            e = np.frombuffer(data, ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), key, np.int64)), pa.array(e["id"].copy()), pa.array(e["size"].astype(np.int64))], ["key", "id", "size"])


def across_components(lists: DataFrame, found: DataFrame, tokens: DataFrame, folder: str) -> DataFrame | None:
    """Links (u, v) between sets of the long lists whose components differ, or None if there are no such sets.

    Lists with the same largest component are taken together, each set once.
    There the sets outside that component meet all others, block by block, with
    their shingles: pairs are verified where they meet.  A block hands on a link
    only if it joins two components that it hasn't joined yet, so what it makes
    is bounded by the sets that it reads.
    """
    rows = lists.mapInArrow(_unlisted, "key long, id long, size long")
    named = rows.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stored(named, folder, "long-lists")
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    heads = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    heads = stored(heads.select("key", F.col("top.component").alias("major")), folder, "mixed-lists")
    if heads.isEmpty():
        return None
    members = named.join(heads, "key").groupBy("major", "id").agg(F.first("size").alias("size"), F.first("component").alias("component"))
    members = stored(members, folder, "mixed-sets")
    minor = F.col("component") != F.col("major")
    blocks = lambda c: F.greatest(F.ceil(F.sum(c) * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    grid = members.groupBy("major").agg(blocks(F.col("size")).alias("blocks"), blocks(F.when(minor, F.col("size")).otherwise(0)).alias("minors"))
    own = F.xxhash64("id")
    cells = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(i.alias("i"), F.pmod(own, F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("asks"))),
        F.when(minor, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.pmod(own, F.col("minors")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("asks")))).otherwise(F.array()),
    )
    placed = members.join(grid, "major").select("major", "id", "component", F.explode(cells).alias("c")).select("major", "c.i", "c.j", "c.asks", "id", "component")
    shipped = placed.join(tokens.withColumnRenamed("set_id", "id"), "id").select("major", "i", "j", "asks", "id", "component", "tokens")
    return shipped.groupBy("major", "i", "j").applyInArrow(_block_links, "u long, v long")


def _block_links(t: pa.Table) -> pa.Table:
    """The links that join components, between the sets that ask and the others of one block."""
    data, offs = flat_text(t.column("tokens"))
    shingle, offs = data.view(U64), offs // 8
    asks, ids, size = np.asarray(t.column("asks")), np.asarray(t.column("id")), np.diff(offs)
    _, component = np.unique(np.asarray(t.column("component")), return_inverse=True)
    mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
    theirs = theirs[np.argsort(size[theirs], kind="stable")]
    left, right = [], []
    if len(mine) and len(theirs):
        sizes = size[theirs]
        at = np.concatenate([[0], np.cumsum(sizes)])
        vocabulary, place = np.unique(shingle[np.repeat(offs[theirs] - at[:-1], sizes) + np.arange(at[-1])], return_inverse=True)
        held = np.zeros(len(vocabulary), np.uint8)
        for i in mine.tolist():
            n = int(size[i])
            lo, hi = np.searchsorted(sizes, -(-SHARE * n // 100)), np.searchsorted(sizes, 100 * n // SHARE, "right")
            other = component[theirs[lo:hi]] != component[i]
            if not other.any():
                continue
            own = shingle[offs[i] : offs[i + 1]]
            k = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            k = k[vocabulary[k] == own]
            held[k] = 1
            same = np.add.reduceat(held[place[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
            held[k] = 0
            for j in theirs[lo:hi][other & (100 * same >= SHARE * (n + sizes[lo:hi] - same))].tolist():
                if component[j] != component[i]:
                    left.append(ids[i])
                    right.append(ids[j])
                    component[component == component[j]] = component[i]
    return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})


def set_links(docs: DataFrame, sets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) between set ids, components (node, component) of the sets with a link).

    All links of short lists are there; of a long list at least those that its components need.
    """
    spark = docs.sparkSession
    sizes = sets.where(f"n_shingles >= {LEAST}").groupBy(F.least("n_shingles", F.lit(SMALL_MOST + 1)).alias("size")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")).collect()
    *levels, list_length = document_levels(docs, sum(r["all"] for r in sizes))
    small = boundary({r.size: r.n for r in sizes}, list_length)
    buckets = max(16, sum(r["all"] for r in sizes) // (4 * ENTRIES) + 1)
    return links_of_index(index_entries(docs, Sent(spark, levels), small, buckets), docs, sets, small, folder)


def links_of_index(index: DataFrame, docs: DataFrame, sets: DataFrame, small: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links and components from packed index entries (bucket, data): candidates, their verification, and the long lists once more."""
    schema = "kind int, a long, b long, key long, list binary"
    got = stored(index.groupBy("bucket").applyInArrow(lambda t: candidates(t, small), schema), folder, "candidates")
    lists = got.where("kind = 1")
    top = lists.groupBy("key").agg(F.min("a").alias("first"), F.count("*").alias("cells")).where("cells > 1")
    over_cells = lists.join(top, "key").where("a <> first").select(F.least("a", "first").alias("a"), F.greatest("a", "first").alias("b"))
    pairs = stored(got.where("kind = 0").select("a", "b").union(over_cells).distinct(), folder, "pairs")
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(lists.mapInArrow(_unlisted, "key long, id long, size long").select("id")).distinct()
    tokens = stored(token_table(docs, sets, ids, folder), folder, "tokens")
    links = stored(verified(pairs, tokens), folder, "links")
    found = components(links, folder)
    more = across_components(lists, found, tokens, folder)
    if more is not None:
        links = links.union(stored(more, folder, "more-links"))
        found = components(links, folder, "all-components")
    return links, found


def set_table(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_shingles, set_id) of each document."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_set_rows, "doc_id long, n_shingles long, set_id long")
    return stored(rows, folder, "sets")


def with_set_id(docs: DataFrame, name: str) -> DataFrame:
    """Adds the set_id of each row's text, null without a word."""
    schema = docs.withColumn(name, F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _sets(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_key(s) if len(s) else None for s in found], pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def survivors(docs: DataFrame) -> DataFrame:
    """(set_id, first_id, component, n_rows): the sets that hold the least doc_id of their component, null only if it has no other.

    n_rows is how many documents of the component have that doc_id.
    """
    folder = shared_folder(docs.sparkSession)
    sets = set_table(docs, folder)
    _, found = set_links(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), sets, folder)
    rows = sets.where("set_id is not null").groupBy("set_id", "doc_id").agg(F.count("*").alias("n"))
    first = rows.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")).alias("f")).select("set_id", F.col("f.doc_id").alias("first_id"), "f.n")
    members = first.join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    members = stored(members, folder, "first-rows")
    least = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    kept = members.join(least, "component").where("first_id <=> component_id")
    n_rows = kept.groupBy("component").agg(F.sum("n").alias("n_rows"))
    return stored(kept.join(n_rows, "component").select("set_id", "first_id", "component", "n_rows"), folder, "survivors")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; component_id is the least doc_id that links lead to."""
    folder = shared_folder(docs.sparkSession)
    sets = set_table(docs, folder)
    _, found = set_links(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), sets, folder)
    return named_components(sets, found, folder)


def named_components(sets: DataFrame, found: DataFrame, folder: str, *more: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) and more of ``sets``'s columns from the documents' sets and the components of linked sets."""
    first = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    in_component = first.join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    in_component = stored(in_component, folder, "members")
    names = in_component.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_set = in_component.join(names, "component").select("set_id", "component_id")
    return sets.join(of_set, "set_id", "left").select("doc_id", "n_shingles", *more, F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
