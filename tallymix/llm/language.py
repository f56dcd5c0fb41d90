"""Language ID by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, kept as sorted arrays of n-gram
hashes beside their counts and looked up by binary search.  A text gets the
language whose model codes it in the fewest nats per character; its score is
the probability of that language, with a sharpness chosen by the log loss on
texts held back from counting.

A symbol is a letter in lower case, or a space for any run of other characters.
Letters up to U+FFFF are 16-bit symbols of their own; those beyond share the
numbers of the private-use area, which has no letters.

Counts are made over all labelled texts but those held back (one in
``HOLD_BACK``, by a hash of the text, so that copies stay together): tasks count
their own n-grams, sums are by hash ranges.  Every n-gram counts, however rare
and however large the corpus; a model is as large as its language has different
n-grams.

A text is rejected if its best rate, less four standard errors of so many
characters, is above a limit.  The limit is set on all texts held back: at the
``KEPT_SHARE`` quantile of their rates under their own language, moved half-way
towards the low end of what they cost under the best of the other languages,
which stands for a language without a model.

Edge cases: null text, or text without a letter: ``und``, score 0, rejected.
Without any labelled text everything is ``und``.  Ties go to the language that
sorts first.  Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, HashTable, Sent, kept, mix64, slices, table

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
PRIVATE, PRIVATE_SIZE = 0xE000, 6400
HOLD_BACK = 10
KEPT_SHARE, FOREIGN_SHARE = 0.999, 0.05
#: What is tried for the sharpness of scores; the middle one holds where nothing is held back.
SHARPNESS = tuple(float(x) for x in np.geomspace(1, 400, 25))
#: Rates are counted in bins of this many nats, up to the last one.
BIN, BINS = 0.01, 2400
UNDETERMINED = "und"
GRAMS_HELD = 1 << 21
#: A sample is drawn by a number below it; fine enough for any corpus.
DRAWS = 1 << 53


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point to symbol."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < SYMBOLS else PRIVATE + low % PRIVATE_SIZE
    return out


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, as one number, the offsets by text, and whether a text has a letter."""
    points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    at = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))]).astype(np.int64)
    c = symbol_table()[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[at[:-1]] = True
    offs = np.concatenate([[0], np.cumsum(keep)])[at]
    c = c[keep].astype(U64)
    code = c.copy()
    for back in range(1, ORDER):
        code[back:] |= c[:-back] << U64(BITS * back)
    for k in range(ORDER - 1):  # what stood before the text counts as spaces
        i = offs[:-1] + k
        i = i[i < offs[1:]]
        code[i] &= U64((1 << (BITS * (k + 1))) - 1)
    letter = np.add.reduceat((c > 0).astype(np.int64), offs[:-1]) > 0 if len(c) else np.zeros(len(texts), bool)
    return code, offs, letter


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their summed counts."""
    values, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(n, first) if len(first) else n


class Counts:
    """A sorted hash array: n-gram hashes, and a count for each."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        h = mix64(codes.astype(U64) + U64(1))
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(codes), np.float32)
        h = mix64(codes.astype(U64) + U64(1))
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, self.values[k], np.float32(0))


class KneserNey:
    """Interpolated Kneser-Ney over n-gram numbers: the highest order by counts, lower ones by the number of distinct left neighbours.

    Each order's discount is n1 / (n1 + 2 n2) of its n-grams seen once and twice.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray | None = None):
        u, n = np.unique(codes, return_counts=True) if n is None else (codes, n)
        self.grams, self.totals, self.kinds, self.discounts, top = [], [], [], [], (u, n)
        for order in range(ORDER, 0, -1):
            contexts, first, kinds = np.unique(u >> U64(BITS), return_index=True, return_counts=True)
            one, two = int((n == 1).sum()), int((n == 2).sum())
            self.discounts.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.1)
            self.grams.append(Counts(u, n))
            self.totals.append(Counts(contexts, np.add.reduceat(n, first) if len(n) else n))
            self.kinds.append(Counts(contexts, kinds))
            u, n = np.unique(u & U64((1 << BITS * (order - 1)) - 1), return_counts=True)
        logs = -np.log(self.probabilities(top[0]))
        total = max(1, top[1].sum())
        self.spread = float(np.sqrt(max(0.0, (top[1] * logs**2).sum() / total - ((top[1] * logs).sum() / total) ** 2)))

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / SYMBOLS)
        for level in range(ORDER - 1, -1, -1):
            part, d = codes & U64((1 << BITS * (ORDER - level)) - 1), self.discounts[level]
            context = part >> U64(BITS)
            t = self.totals[level].of(context).astype(np.float64)
            seen = np.maximum(self.grams[level].of(part) - d, 0)
            mixed = (seen + d * self.kinds[level].of(context) * p) / np.maximum(t, 1)
            p = np.where(t > 0, mixed, p)
        return p


class LanguageModel:
    """The models of all languages, the limit of nats per character above which a text is rejected, and the scores' sharpness."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.models = [KneserNey(*counts[name]) for name in self.languages]
        self.limit, self.sharpness = np.inf, SHARPNESS[len(SHARPNESS) // 2]
        self.spread = max([m.spread for m in self.models], default=0.0)

    def allowance(self, n: np.ndarray) -> np.ndarray:
        """How far the rate of a text of n characters may stray: four standard errors."""
        return 4 * self.spread / np.sqrt(np.maximum(n, 1))

    def calibrate(self, own: np.ndarray, other: np.ndarray, losses: np.ndarray) -> None:
        """From counts by bin of the held-back texts' rates, less their allowance, and the log losses by sharpness."""

        def quantile(counts: np.ndarray, share: float) -> float:
            return BIN * (int(np.searchsorted(np.cumsum(counts), share * counts.sum())) + 1)

        if own.sum():
            low = quantile(own, KEPT_SHARE)
            far = quantile(other, FOREIGN_SHARE) if other.sum() else low
            self.limit = low + 0.5 * max(0.0, far - low)
            self.sharpness = SHARPNESS[int(np.argmin(losses))]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in one process; keeps the log probabilities of every n-gram it has met."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number, self.logs, self.used = HashTable(), np.zeros((1 << 12, len(self.model.languages)), np.float32), 0

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol (texts by languages), whether a text has a letter, and its symbols."""
        if self.used > GRAMS_HELD:
            self._clear()
        code, offs, letter = gram_codes(texts)
        h = mix64(code + U64(1))
        k = self.number.find(h)
        miss = np.flatnonzero(k < 0)
        if len(miss):
            new = np.unique(code[miss])
            n = self.used + len(new)
            if n > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros((max(n, len(self.logs)), self.logs.shape[1]), np.float32)])
            for j, m in enumerate(self.model.models):
                self.logs[self.used : n, j] = -np.log(m.probabilities(new))
            self.number.enter(mix64(new + U64(1)), np.arange(self.used, n, dtype=np.int32))
            self.used = n
            k[miss] = self.number.find(h[miss])
        logs = self.logs[k]
        sums = np.stack([np.add.reduceat(logs[:, j], offs[:-1], dtype=np.float64) for j in range(logs.shape[1])], 1)
        n = np.diff(offs)
        return sums / n[:, None], letter, n

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        use = [k for k, t in enumerate(texts) if t and self.model.languages]
        if use:
            rates, letter, n = self.rates([texts[k] for k in use])
            best = rates.argmin(1)
            least = rates.min(1)
            score = 1.0 / np.exp(-self.model.sharpness * (rates - least[:, None])).sum(1)
            for k, b, s, over, ok in zip(use, best, score, least - self.model.allowance(n) > self.model.limit, letter, strict=True):
                if ok:
                    out[k] = (self.model.languages[b], float(s), bool(over))
        return out


def _held_back() -> Column:
    return F.pmod(F.xxhash64("text", F.lit(8)), F.lit(HOLD_BACK)) == 0


def gram_counts(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language its n-grams and their counts over all texts (lang, text)."""
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        since = 0
        for b in (part for batch in batches for part in slices(batch)):
            names, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for name in set(names):
                got = np.unique(gram_codes([t for t, x in zip(texts, names, strict=True) if x == name])[0], return_counts=True)
                held.setdefault(name, []).append(got)
                since += len(got[0])
            if since > 1 << 21:
                held, since = {name: [merged(x)] for name, x in held.items()}, 0
        for name, x in held.items():
            values, n = merged(x)
            part = (mix64(values) >> U64(60)).astype(np.int64)
            for p in range(parts):
                at = part == p
                if at.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([p], pa.int32()), pa.array([values[at].tobytes()], pa.binary()), pa.array([n[at].astype("<i8").tobytes()], pa.binary())], ["lang", "part", "grams", "n"])

    def total(t: pa.Table) -> pa.Table:
        name = t.column("lang")[0].as_py()
        # two by two, so that what tasks have sent is not unpacked at once
        values, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for g, m in zip(t.column("grams"), t.column("n"), strict=True):
            values, n = merged([(values, n), (np.frombuffer(g.as_buffer(), U64), np.frombuffer(m.as_buffer(), np.int64))])
        return pa.table({"lang": [name], "part": t.column("part")[:1], "grams": pa.array([values.tobytes()], pa.binary()), "n": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    schema = "lang string, part int, grams binary, n binary"
    rows = docs.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(total, schema).collect()
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append((np.frombuffer(r.grams, U64), np.frombuffer(r.n, np.int64)))
    return {name: merged(x) for name, x in found.items()}


def _calibration(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(kind, bin, value): counts of own (0) and best other rates (1) by bin, and log losses (2) by sharpness; summed by task, then by Spark."""
    sent = Sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("scorer", sent.id), lambda: sent.value.scorer())
        hist, losses = np.zeros((2, BINS)), np.zeros(len(SHARPNESS))
        for b in (part for batch in batches for part in slices(batch)):
            rows = [(t, model.languages.index(x)) for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True) if t and x in sent.value.languages]
            if not rows:
                continue
            rates, letter, n = scorer.rates([t for t, _ in rows])
            own = np.array([k for _, k in rows])[letter]
            rates, spare = rates[letter], sent.value.allowance(n[letter])
            at = np.arange(len(rates))
            place = lambda x: np.clip(((x - spare) / BIN).astype(np.int64), 0, BINS - 1)
            np.add.at(hist[0], place(rates[at, own]), 1)
            for k, s in enumerate(SHARPNESS):
                losses[k] += np.log(np.exp(-s * (rates - rates[at, own][:, None])).clip(1e-300, 1e300).sum(1)).sum()
            if rates.shape[1] > 1:
                rates[at, own] = np.inf
                np.add.at(hist[1], place(rates.min(1)), 1)
        rows = [(k, j, hist[k, j]) for k in (0, 1) for j in np.flatnonzero(hist[k]).tolist()] + [(2, k, x) for k, x in enumerate(losses)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(r[2]) for r in rows], pa.float64())], ["kind", "bin", "value"])

    return docs.select("lang", "text").mapInArrow(run, "kind int, bin int, value double").groupBy("kind", "bin").agg(F.sum("value").alias("value"))


def fit(docs: DataFrame) -> LanguageModel:
    """Models from all labelled texts (lang, text), the limit and the sharpness from those held back.

    If a language has no text beyond those held back, none are held back.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = gram_counts(known.where(~_held_back()))
    if len(counts) < known.select("lang").distinct().count():
        return LanguageModel(gram_counts(known))
    model = LanguageModel(counts)
    own, other, losses = np.zeros(BINS), np.zeros(BINS), np.zeros(len(SHARPNESS))
    if counts:
        for r in _calibration(known.where(_held_back()), model).collect():
            (own, other, losses)[r.kind][r.bin] = r.value
    model.calibrate(own, other, losses)
    return model


def identify(df: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and rejected; columns of these names are replaced."""
    sent = Sent(df.sparkSession, model)
    base = df.drop("lang_pred", "score", "rejected")
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("scorer", sent.id), lambda: sent.value.scorer())
        for b in (part for batch in batches for part in slices(batch)):
            got = scorer.judge(b.column("text").to_pylist())
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def held_out() -> Column:
    """crc32 of doc_id as text leaves 0 by 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(F.coalesce(~held_out(), F.lit(True))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
