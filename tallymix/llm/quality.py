"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Each word, and each word's shape (runs of lower case, upper case, digits, other
characters), has a fixed random index vector by hash.  Its word vector adds the
mean of the index vectors of its neighbours over all documents: they are of -1,
0 and 1, so tasks' sums are whole numbers and don't depend on their order.  A
document is the mean and the spread of its words' and shapes' vectors, how like
they are to the next one's, and its length.  The network is written in numpy;
one temperature, chosen on texts held back from fitting, calibrates its
probabilities.

The network alone is fitted on about ``FIT_ROWS`` labelled rows, drawn by a hash
of doc_id; that bound is a parameter.  Their texts are pooled where they are
read; only the inputs meet on the driver.  All texts are scored whole.

Edge cases: null, empty and blank texts have zero vectors and length 0 and get
the network's probability for that; rows without a label don't count for
fitting; with no labelled row every score is 0.5, with one label only the
model still answers; repeated rows score alike; other columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, flat_text, random_u64, slices, table, word_hashes, word_spans
from .language import DRAWS, held_out

FIT_ROWS = 6000
BUCKETS, DIMS, WINDOW = 1 << 15, 32, 2
INPUTS = 4 * DIMS + 3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
#: Bytes of text whose neighbours are counted at a time.
COUNT_SLICE = 1 << 19


def _shape_classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[97:123], out[128:] = 97, 97
    out[65:91], out[48:58] = 65, 48
    return out


_SHAPES = _shape_classes()


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the bucket and its shape's bucket (the upper half of the table), and the words' offsets by text."""
    ws, wo = word_spans(data, offs)
    words = (word_hashes(data, ws) >> np.uint64(50)).astype(np.int64)
    classes = _SHAPES[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[ws] = True
    shapes = word_hashes(classes[keep], (np.cumsum(keep) - 1)[ws], lower=False) if len(ws) else np.zeros(0, np.uint64)
    return words, (shapes >> np.uint64(50)).astype(np.int64) + BUCKETS // 2, wo


def index_vectors() -> np.ndarray:
    bits = random_u64(BUCKETS * DIMS, 401) >> np.uint64(61)
    return np.choose(np.minimum(bits, 2).astype(int), [-1, 1, 0]).astype(np.int8).reshape(BUCKETS, DIMS)


def neighbour_sums(data: np.ndarray, offs: np.ndarray, index: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
    """Adds, for each word's and each shape's bucket, its neighbours' index vectors to ``sums`` and their number to ``seen``."""
    words, shapes, wo = word_buckets(data, offs)
    n = len(words)
    text = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    near = [(d, text[d:] == text[: n - d]) for d in range(1, min(WINDOW, n - 1) + 1)]
    number = np.zeros(n, np.int64)
    for d, same in near:
        number[d:] += same
        number[: n - d] += same
    for b in (words, shapes):
        own, around = index[b], np.zeros((n, DIMS), np.int8)
        for d, same in near:
            around[d:] += own[: n - d] * same[:, None]
            around[: n - d] += own[d:] * same[:, None]
        order = np.argsort(b.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) != 0])) if n else np.zeros(0, np.int64)
        if n:
            at = b[order][first]
            sums[at] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
            seen[at] += np.add.reduceat(number[order], first)


def word_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors: own index plus the mean of the neighbours'."""
    out = index_vectors() + sums / np.maximum(seen, 1)[:, None]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def random_indexing(docs: DataFrame) -> np.ndarray:
    """The word vectors of all texts; what tasks send is by ranges of buckets, compressed, and as large as the table at most."""
    parts = 32
    width = BUCKETS // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums, seen = index_vectors(), np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
        for b in (part for batch in batches for part in slices(batch, most=COUNT_SLICE)):
            neighbour_sums(*flat_text(b.column(0)), index, sums, seen)
        for p in range(parts):
            at = slice(p * width, (p + 1) * width)
            if seen[at].any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(np.column_stack([seen[at], sums[at]]))], pa.binary())], ["part", "data"])

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros((width, DIMS + 1), np.int64)
        for data in t.column("data"):
            out += _unpacked(data.as_py(), out.shape)
        return pa.table({"part": t.column("part")[:1], "data": pa.array([_packed(out)], pa.binary())})

    schema = "part int, data binary"
    sums, seen = np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(total, schema).collect():
        x = _unpacked(r["data"], (width, DIMS + 1))
        seen[r.part * width : (r.part + 1) * width], sums[r.part * width : (r.part + 1) * width] = x[:, 0], x[:, 1:]
    return word_vectors(sums, seen)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by byte plane of the least width that holds them, compressed."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) <= np.iinfo(k).max)
    planes = x.astype(kind).ravel().view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<i{data[0]}").reshape(shape).astype(np.int64)


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, INPUTS): mean and spread of word vectors and of shape vectors, their likeness to the next one's, and the log of the length."""
    words, shapes, wo = word_buckets(data, offs)
    n = np.diff(wo)
    out = np.zeros((len(n), INPUTS), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        at = wo[:-1][full]
        for k, b in enumerate((words, shapes)):
            v = vectors[b]
            mean = np.add.reduceat(v, at, axis=0) / n[full, None]
            spread = np.add.reduceat(v * v, at, axis=0) / n[full, None] - mean**2
            out[full, 2 * k * DIMS : (2 * k + 1) * DIMS] = mean
            out[full, (2 * k + 1) * DIMS : (2 * k + 2) * DIMS] = np.sqrt(np.maximum(spread, 0))
            alike = np.append(np.einsum("ij,ij->i", v[:-1], v[1:]), np.float32(0))
            alike[wo[1:][full] - 1] = 0  # a text's last word has no next one
            out[full, 4 * DIMS + k] = np.add.reduceat(alike, at) / n[full]
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Inputs scaled, one hidden layer of tanh, one logit, divided by a temperature."""

    def __init__(self, inputs: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.weights = [rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> Network:
        """Adam on the cross-entropy; then the temperature on the rows held back."""
        rng = np.random.default_rng(seed)
        back = rng.random(len(x)) < 0.2 if len(x) >= 20 else np.zeros(len(x), bool)
        self.mean, self.scale = x[~back].mean(0), x[~back].std(0) + 1e-3
        z, t = (x[~back] - self.mean) / self.scale, y[~back]
        m, v, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for k in range(0, len(z), BATCH):
                i = order[k : k + BATCH]
                w1, b1, w2, b2 = self.weights
                h = np.tanh(z[i] @ w1 + b1)
                e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50))) - t[i]) / len(i)
                g = e[:, None] * w2 * (1 - h**2)
                step += 1
                for j, d in enumerate((z[i].T @ g + DECAY * w1, g.sum(0), h.T @ e + DECAY * w2, e.sum(keepdims=True))):
                    m[j] = 0.9 * m[j] + 0.1 * d
                    v[j] = 0.999 * v[j] + 0.001 * d**2
                    self.weights[j] = self.weights[j] - RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        if back.any():
            self.temperature = temperature(self.logits(x[back]), y[back])
        return self


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy, of a geometric grid from 1/4 to 16."""
    grid = np.geomspace(0.25, 16, 121)
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


class QualityModel:
    """Word vectors, and the network on pooled texts (inputs x, labels y)."""

    def __init__(self, vectors: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.vectors, self.network = vectors, Network(INPUTS)
        if len(x):
            self.network.fit(x, y)
        else:
            self.network.weights = [np.zeros_like(w) for w in self.network.weights]

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.network.probabilities(pooled(*flat_text(column), self.vectors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", wanted: int = FIT_ROWS) -> QualityModel:
    """Vectors from all texts; the network from about ``wanted`` labelled rows, at most twice as many, in the order of a hash."""
    vectors = random_indexing(docs)
    sent = Sent(docs.sparkSession, vectors)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"), F.expr("xxhash64(doc_id, 9)").alias("h"))
    share = min(1.0, wanted / max(1, known.count()))
    drawn = known.where(F.pmod("h", F.lit(DRAWS)) < int(share * DRAWS)).orderBy("h", "doc_id", "y").limit(2 * wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            x = pooled(*flat_text(b.column("text")), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("t"), b.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], ["h", "t", "y", "x"])

    # at most 2 * wanted labels: a bounded table
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "y", "h", F.xxhash64("text").alias("t"))
    rows = texts.mapInArrow(run, "h long, t long, y double, x binary").orderBy("h", "t", "y").limit(4 * wanted).collect()
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, INPUTS).astype(float)
    return QualityModel(vectors, x, np.array([r.y for r in rows], float))


def score(df: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """Adds each text's probability of label 1; a column of that name is replaced."""
    base, sent = df.drop(out), Sent(df.sparkSession, model)
    schema = base.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(b.column("text")), pa.float64())], schema.names)

    return base.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(F.coalesce(~held_out(), F.lit(True))))
    out = score(docs, model)
    return out.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
