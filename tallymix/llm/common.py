"""What the corpus operators share: flat text, hashed words and shingles, shared folders, components.

Texts are handled whole and in Arrow batches.  A batch's texts become one flat
byte array with offsets, so that hashing is vectorised over all of its words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Bytes of words hashed at a time; keeps the temporaries in cache.
SEGMENT = 1 << 20
SHINGLE_WORDS = 5


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    That is the session's ``spark.checkpoint.dir``.  Where it is unset a
    temporary folder is made and set on one machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallymix-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallymix-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it: cuts lineage, and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sent:
    """A broadcast value, and a name by which worker processes can keep what they derive from it."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps from task to task: one thing at a time, made when another is wanted."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives up what ``kept`` holds, and Arrow's unused memory; for tasks that keep nothing but may follow others in their process."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


#: Bytes of an Arrow batch on its way to Python, unless the session sets another size.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark cut Arrow batches by bytes, since rows may be long texts."""
    own = spark.conf.get(_BATCH_SETTING) or ""
    if not own.rstrip("b").isdigit() or int(own.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class HashTable:
    """Numbers of 64-bit keys other than 0: open addressing, all keys of a call at a time; doubles when half full."""

    def __init__(self, bits: int = 17):
        self.bits, self.count = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where a key isn't there."""
        slot, out = self._slots(h), np.full(len(h), -1, np.int32)
        key = self.keys[slot]
        hit = key == h
        np.copyto(out, self.numbers[slot], where=hit)
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.numbers[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def enter(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct new keys; of those that want one slot the last written stays, the others go on."""
        if 2 * (self.count + len(h)) > len(self.keys):
            full = self.keys != 0
            keys, values = self.keys[full], self.numbers[full]
            self.bits = max(self.bits + 1, (2 * (self.count + len(h))).bit_length())
            self.keys, self.numbers, self.count = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32), 0
            self.enter(keys, values)
        self.count += len(h)
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.numbers[slot[won]] = numbers[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * GOLDEN)


def is_space(data: np.ndarray) -> np.ndarray:
    """Space and the control characters tab to carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and offsets (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


#: Bytes of text worked on at a time, at least one text.
SLICE = 1 << 21


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; bounds the temporaries by the longest text."""
    _, offs = flat_text(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_BYTES = random_u64(256, 11)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_BASE = U64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 2 * len(_POWERS)) - 1, _BASE)]))
    return _POWERS


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in the flat bytes, and the words' offsets by text."""
    word = ~is_space(data)
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offs[:-1][(offs[:-1] < len(data))]
    start[inner] = word[inner]
    ws = np.flatnonzero(start)
    return ws, np.searchsorted(ws, offs)


def word_hashes(data: np.ndarray, ws: np.ndarray, lower: bool = True) -> np.ndarray:
    """64 bits for each word: a polynomial in an odd base over random byte values, then mixed.

    White space counts 0 and so may trail a word.
    """
    out, values = np.empty(len(ws), U64), _BYTES_LOWER if lower else _BYTES
    ends = np.append(ws[1:], len(data))
    k = 0
    with np.errstate(over="ignore"):
        while k < len(ws):
            m = max(k + 1, int(np.searchsorted(ends, ws[k] + SEGMENT)))
            a, b = int(ws[k]), int(ends[m - 1])
            size = ends[k:m] - ws[k:m]
            at = np.arange(a, b) - np.repeat(ws[k:m], size)
            out[k:m] = np.add.reduceat(values[data[a:b]] * _powers(int(size.max()))[at], ws[k:m] - a)
            k = m
    return mix64(out)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row, and their offsets by text."""
    ws, wo = word_spans(data, offs)
    return word_hashes(data, ws), wo


def shingles(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles.

    Fewer words make one shingle of all of them; no word makes none.
    """
    return (s for s, _ in shingles_of(*words_of(data, offs)))


def shingles_of(h: np.ndarray, wo: np.ndarray, level: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The same from words, and, where words have levels, for each shingle the least of its words'."""
    factors = random_u64(SHINGLE_WORDS, 23) | U64(1)
    n, k = len(h), SHINGLE_WORDS
    size = max(0, n - k + 1)
    full = np.zeros(size, U64)
    least = None if level is None else level[:size].copy()
    with np.errstate(over="ignore"):
        for j in range(k if size else 0):
            full += h[j : j + size] * factors[j]
            if least is not None:
                np.minimum(least, level[j : j + size], out=least)
        full = mix64(full)
        for i in range(len(wo) - 1):
            a, b = wo[i], wo[i + 1]
            if b - a >= k:
                if least is None:
                    s, low = np.sort(full[a : b - k + 1]), None
                else:
                    order = np.argsort(full[a : b - k + 1])
                    s, low = full[a : b - k + 1][order], least[a : b - k + 1][order]
                if len(s) > 1:
                    new = np.concatenate(([True], s[1:] != s[:-1]))
                    s, low = s[new], None if low is None else low[new]
                yield s, low
            elif b > a:
                yield mix64(np.array([(h[a:b] * factors[: b - a]).sum(dtype=U64) + U64(b - a) * GOLDEN], U64)), None if level is None else level[a:b].min(keepdims=True)
            else:
                yield np.zeros(0, U64), None if level is None else level[:0]


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set of shingles, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s ^ GOLDEN).sum(dtype=U64) + U64(len(s))], U64)).view(np.int64)[0])


#: Nodes of a union-find at a time.
TREES = 100_000


def _forest(batches: Iterator[pa.RecordBatch], most: int = TREES) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: at most one link for each node seen, to the least of its tree.

    Whenever it has ``most`` nodes it hands them on and starts anew, so memory doesn't grow with the partition.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def made() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
        if len(parent) >= most:
            yield made()
    if parent:
        yield made()


#: Up to so many links, after the partitions' own contraction, one more union-find ends it.
FEW_LINKS = 250_000
#: Star rounds take about log^2 of the longest chain; more than these mean an error.
ROUNDS = 200


def components(links: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable over ``links`` (u, v), for each node of a link.

    First each partition contracts its links by union-find.  If few are left, one
    task contracts them; else large-star and small-star alternate.  Both take
    the least neighbour by a pre-aggregated minimum, so no node's neighbours are
    ever gathered; every round is written to the shared folder.
    """
    edges = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, "u long, v long")
    edges = stored(edges, folder, f"{name}-0")
    if edges.count() <= FEW_LINKS:
        edges = stored(edges.coalesce(1).mapInArrow(lambda batches: _forest(batches, 1 << 62), "u long, v long"), folder, f"{name}-1")
        return _named(edges)
    before = None
    for k in range(1, ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), folder, f"{name}-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(u as decimal(38,0))")), F.sum(F.expr("cast(v as decimal(38,0))"))).first())
        if now == before:
            return _named(edges)
        before = now
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")


def _named(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v"))).distinct()
