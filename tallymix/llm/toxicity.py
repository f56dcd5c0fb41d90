"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits (any character beyond ASCII counts as one),
A-Z in lower case.  A text's features are the distinct 64-bit hashes of its
words, its pairs and threes of consecutive words, and its pairs with one or two
words between.  Each has a learning rate of its own, by the squared gradients it
has seen; the L1 term keeps all weights at zero that don't earn their place, so
the model is two short sorted arrays, however many features there are.

The model alone is fitted on a bounded sample of labelled rows: about
``FIT_ROWS`` by a hash of doc_id, as far as their texts have at most
``FIT_CHARS`` code points in that order.  Both bounds are parameters.  Features
that fewer than ``LEAST_TEXTS`` of the sample's texts of label 1 hold aren't
fitted; Spark counts them, and only their numbers in each text meet on the
driver.  All texts are scored whole.

Edge cases: null, empty and blank texts have no features and get the intercept's
probability; rows without a label don't count for fitting; without a labelled
row every score is 0.5; repeated rows score alike; other columns pass through,
but one named like the score is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Sent, flat_text, mix64, random_u64, shared_folder, slices, stored, table, word_hashes, word_spans
from .language import DRAWS

FIT_ROWS, FIT_CHARS, LEAST_TEXTS = 16_000, 60_000_000, 3
#: Places of the words of each kind of feature.
KINDS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
ALPHA, BETA, L1, L2, EPOCHS = 10.0, 1.0, 4.0, 0.0, 6
THRESHOLD = 0.7
#: Features looked up at a time.
LOOKED_UP = 1 << 20

_AS_SPACE = np.arange(256, dtype=np.uint8)
_AS_SPACE[[b for b in range(128) if not chr(b).isalnum()]] = 32
_FACTORS = random_u64(len(KINDS) * 4, 811).reshape(len(KINDS), 4) | U64(1)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and their offsets by text."""
    plain = _AS_SPACE[data]
    ws, wo = word_spans(plain, offs)
    return word_hashes(plain, ws), wo


def features_of(h: np.ndarray, wo: np.ndarray, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts and hashes of the features of kind ``k`` that start at words a to b; none crosses a text's end."""
    places = KINDS[k]
    at = np.arange(a, min(b, len(h) - places[-1]))
    text = np.searchsorted(wo, at, "right") - 1
    inside = at + places[-1] < wo[text + 1]
    at, text = at[inside], text[inside]
    out = np.full(len(at), k + 1, U64)
    with np.errstate(over="ignore"):
        for j, p in enumerate(places):
            out += h[at + p] * _FACTORS[k, j]
    return text, mix64(out)


def distinct_features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    h, wo = words_of(data, offs)
    found = [features_of(h, wo, k, 0, len(h)) for k in range(len(KINDS))]
    text, value = np.concatenate([t for t, _ in found]), np.concatenate([v for _, v in found])
    order = np.argsort(text, kind="stable")
    value = value[order]
    edges = np.searchsorted(text[order], np.arange(len(offs)))
    return [np.unique(value[edges[i] : edges[i + 1]]) for i in range(len(offs) - 1)]


class ToxicityModel:
    """Sorted hashes of features, their weights, and an intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        self.hashes, self.weights, self.intercept = hashes, weights, intercept

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offs = flat_text(column)
        h, wo = words_of(data, offs)
        found = []
        for k in range(len(KINDS)):
            for a in range(0, len(h), LOOKED_UP):
                text, value = features_of(h, wo, k, a, a + LOOKED_UP)
                at = np.searchsorted(self.hashes, value)
                hit = at < len(self.hashes)
                hit[hit] = self.hashes[at[hit]] == value[hit]
                found.append(np.unique(text[hit] * len(self.hashes) + at[hit]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n = max(1, len(self.hashes))
        logit = self.intercept + np.bincount(both // n, weights=self.weights[both % n] if len(both) else None, minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 3) -> np.ndarray:
    """Weights of features 0 to size - 1 and, last, the intercept, which has no penalty; each row lists the features it holds."""
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    first, second = np.append(np.full(size, l1), 0.0), np.append(np.full(size, l2), 0.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= first[at], 0.0, (np.sign(zi) * first[at] - zi) / ((beta + np.sqrt(ni)) / alpha + second[at]))
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -50, 50))) - y[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    np.copyto(w, np.where(np.abs(z) <= first, 0.0, (np.sign(z) * first - z) / ((beta + np.sqrt(n)) / alpha + second)))
    return w


def places_in(common: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The places in a sorted array of those values that it holds."""
    at = np.searchsorted(common, found)
    hit = at < len(common)
    hit[hit] = common[at[hit]] == found[hit]
    return at[hit]


def model_of(rows: list[np.ndarray], y: np.ndarray, features: np.ndarray) -> ToxicityModel:
    """Fitted on the places of texts' features in a sorted array of them, and on their labels."""
    if not len(rows):
        return ToxicityModel(np.zeros(0, U64), np.zeros(0), 0.0)
    w = ftrl([np.append(at, len(features)) for at in rows], y, len(features))
    used = np.flatnonzero(w[:-1])
    return ToxicityModel(features[used], w[:-1][used], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", wanted: int = FIT_ROWS, most: int = FIT_CHARS, least: int = LEAST_TEXTS) -> ToxicityModel:
    """From about ``wanted`` labelled rows, at most twice as many, with at most ``most`` code points, in the order of a hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"), F.expr("xxhash64(doc_id, 31)").alias("h"))
    share = min(1.0, wanted / max(1, known.count()))
    drawn = known.where(F.pmod("h", F.lit(DRAWS)) < int(share * DRAWS)).orderBy("h", "doc_id", "y").limit(2 * wanted)
    # at most 2 * wanted labels: a bounded table
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "y", "h", F.xxhash64("text").alias("t"), F.char_length("text").alias("n"))
    rows = stored(texts, shared_folder(docs.sparkSession), "drawn")
    order = W.orderBy("h", "t", "y")  # of the sample's rows, without their texts
    upto = rows.select("h", "t", "y", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("all_"), F.row_number().over(order).alias("k_"))
    last = upto.where((F.col("all_") <= most) & (F.col("k_") <= 2 * wanted)).agg(F.max(F.struct("h", "t", "y")).alias("m")).first().m
    if last is None:
        return model_of([], np.zeros(0), np.zeros(0, U64))
    rows = rows.where(F.struct("h", "t", "y") <= F.struct(F.lit(last.h), F.lit(last.t), F.lit(last.y)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *distinct_features(*flat_text(b.column("text")))]).view(np.int64))], ["f"])

    often = rows.where("y > 0").select("text").mapInArrow(held, "f long").groupBy("f").count().where(F.col("count") >= least)
    features = np.sort(often.select("f").toPandas()["f"].to_numpy(np.int64).view(U64))  # at most the sample's code points
    sent = Sent(docs.sparkSession, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            found = [places_in(sent.value, x).astype("<i4").tobytes() for x in distinct_features(*flat_text(b.column("text")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "t", "y")), pa.array(found, pa.binary())], ["h", "t", "y", "x"])

    found = rows.select("text", "h", "t", "y").mapInArrow(run, "h long, t long, y double, x binary").orderBy("h", "t", "y").collect()
    return model_of([np.frombuffer(r.x, "<i4").astype(np.int64) for r in found], np.array([r.y for r in found], float), features)


def score(df: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """Adds each text's probability of label 1."""
    base, sent = df.drop(out), Sent(df.sparkSession, model)
    schema = base.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(b.column("text")), pa.float64())], schema.names)

    return base.mapInArrow(run, schema)


def held_out() -> Column:
    """crc32 of doc_id as text leaves 1 by 3."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(F.coalesce(~held_out(), F.lit(True))))
    out = score(docs, model)
    return out.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
