"""Target-distribution importance resampling: documents whose words are likelier in a target corpus, drawn without replacement.

Each hashed feature (a run of words) has a gain: the log of how much commoner
its bucket is in the target than in the documents, in thousandths and floored.
A document's weight is the floored mean of its features' gains; its score adds
Gumbel noise from a hash of its id, so that the highest scores are a draw
without replacement in proportion to exp(weight / 1000).

Weights come from one array of gains, as long as there are buckets.  The draw
merges sorted runs: every task sorts its eligible rows and cuts them, at keys
from regular samples of all runs, into ranges and pages.  A range's pages, in
the order of their first keys, pass through a tournament tree that holds one
leaf for each page that is open, so memory doesn't grow with a range.  Ranks go
on from what lies in the ranges before; ranges after the exact draw count
aren't merged, and the one in which it is reached stops there.  Only sampled
keys (at most ``MARKS`` and one per run) and one count per range meet on the
driver; they steer the balance and never the result.

Rows go by score, then the smaller doc_id, null last, then a hash of the text;
rows that tie in all three are alike.

Edge cases: a null text has no words; a document without features has weight 0;
a null doc_id hashes as empty text; repeated rows are drawn one by one; an empty
target gives gains of the documents alone; an empty table gives an empty result.
``resample`` passes other columns through, also those named like what is made.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, flat_text, partitions, shared_folder, slices, stored, table

BUCKETS, LEAST_RUN, MOST_RUN = 10_000, 1, 1
LEAST_WORDS, SHARE, SEED = 20, 10, 2024
#: Features whose checksums are made at a time, and the length in bytes from which one is made by itself.
SPANS, LONG = 1 << 18, 1 << 12
PAGE = 4096
MARKS = 20_000
RANGE_ROWS = 1 << 16


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each span of the bytes: one step of all spans for each place, longest first."""
    out = np.zeros(len(start), np.uint32)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    at, n = start[short], size[short]
    state = np.full(len(short), 0xFFFFFFFF, np.uint32)
    active = len(short)
    for j in range(int(n[0]) if len(n) else 0):
        active = int(np.searchsorted(-n[:active], -j, "left"))
        s = state[:active]
        state[:active] = _CRC[(s ^ data[at[:active] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[short] = ~state
    return out


_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def feature_buckets(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, least_run: int = LEAST_RUN, most_run: int = MOST_RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of flat texts: (text of each feature, its bucket, words of each text), by length of run."""
    data = _LOWER[data]
    word = _IN_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    first[inner] = word[inner]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    wo = np.searchsorted(start, offs)
    n_words, size = np.diff(wo), end - start
    # the words alone, one space after each: a run of words is a span of these bytes
    to = np.cumsum(size + 1) - size - 1
    packed = np.full(int((size + 1).sum()), 32, np.uint8)
    place = np.cumsum(first) - 1
    keep = np.flatnonzero(word)
    packed[keep - start[place[keep]] + to[place[keep]]] = data[keep]
    for k in range(least_run, most_run + 1):
        heads = np.maximum(n_words - k + 1, 0)
        text = np.repeat(np.arange(len(n_words)), heads)
        head = np.arange(len(text)) - np.repeat(np.cumsum(heads) - heads, heads) + np.repeat(wo[:-1], heads)
        for a in range(0, max(1, len(head)), SPANS):
            h = head[a : a + SPANS]
            crc = crc32_spans(packed, to[h], to[h + k - 1] + size[h + k - 1] - to[h])
            yield text[a : a + SPANS], (crc % np.uint32(buckets)).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, least_run: int = LEAST_RUN, most_run: int = MOST_RUN) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket: tasks count, Spark adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in (part for batch in batches for part in slices(batch, 0)):
            for _, found, _ in feature_buckets(*flat_text(b.column(0)), buckets, least_run, most_run):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: the log of its smoothed share in the target over that in the documents, in floored thousandths."""
    s, t = docs.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A whole number below 2^32 from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


ROW = "doc_id long, tie long, n_features long, weight long, score long, eligible boolean"


def scored(docs: DataFrame, gain: np.ndarray, least_run: int = LEAST_RUN, most_run: int = MOST_RUN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, n_features, weight, score, eligible) of each document; tie is a hash of the text."""
    sent = Sent(docs.sparkSession, gain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), noise(F.col("doc_id")).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in (part for batch in batches for part in slices(batch)):
            n, total, words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for text, found, words in feature_buckets(*flat_text(b.column("text")), len(gain), least_run, most_run):
                n += np.bincount(text, minlength=b.num_rows)
                total += np.bincount(text, weights=gain[found], minlength=b.num_rows).astype(np.int64)  # whole numbers far below 2^53
            weight = total // np.maximum(n, 1)
            h = np.asarray(b.column("h")).astype(float)
            score = weight + np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), *(pa.array(x, pa.int64()) for x in (n, weight, score)), pa.array(words >= least_words)], ["doc_id", "tie", "n_features", "weight", "score", "eligible"])

    return rows.mapInArrow(run, ROW)


class Tournament:
    """A tree of matches over leaves with keys: the least key wins; leaves come and go."""

    def __init__(self, size: int = 8):
        self.size, self.keys, self.winner, self.free = size, [None] * size, [-1] * (2 * size), list(range(size - 1, -1, -1))

    def _match(self, a: int, b: int) -> int:
        if a < 0 or self.keys[a] is None:
            return b
        return a if b < 0 or self.keys[b] is None or self.keys[a] <= self.keys[b] else b

    def put(self, leaf: int, key: tuple | None) -> None:
        """A leaf's new key, None if it leaves; its matches are played again up to the root."""
        self.keys[leaf] = key
        if key is None:
            self.free.append(leaf)
        node = (leaf + self.size) >> 1
        self.winner[leaf + self.size] = leaf
        while node:
            self.winner[node] = self._match(self.winner[2 * node], self.winner[2 * node + 1])
            node >>= 1

    def enter(self, key: tuple) -> int:
        if not self.free:
            keys, n = self.keys, self.size
            self.__init__(2 * n)
            self.free = list(range(2 * n - 1, n - 1, -1))
            for leaf, k in enumerate(keys):
                self.put(leaf, k)
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def top(self) -> int:
        """The winning leaf; -1 without any."""
        leaf = self.winner[1]
        return leaf if leaf >= 0 and self.keys[leaf] is not None else -1


def _key(score: int, doc_id: int | None, tie: int) -> tuple:
    return -score, doc_id is None, doc_id or 0, tie


class _Page:
    """A sorted piece of a run."""

    def __init__(self, row: dict):
        self.scores, self.ids, self.ties, self.counts, self.weights = (row[c] for c in ("scores", "ids", "ties", "counts", "weights"))
        self.at = 0

    def key(self) -> tuple | None:
        i = self.at
        return _key(self.scores[i], self.ids[i], self.ties[i]) if i < len(self.scores) else None

    def take(self) -> tuple:
        i = self.at
        self.at += 1
        return self.ids[i], self.ties[i], self.counts[i], self.weights[i], self.scores[i]


def merged(pages: Iterator[dict], before: int, draw: int) -> Iterator[tuple]:
    """A range's rows with ranks from ``before`` + 1 on; once ``draw`` is reached the rest comes unordered, without a rank."""
    tree, opened, rank = Tournament(), {}, before
    waiting = next(pages, None)
    waiting = waiting and _Page(waiting)
    while rank < draw:
        leaf = tree.top()
        while waiting and (leaf < 0 or waiting.key() < tree.keys[leaf]):
            opened[tree.enter(waiting.key())] = waiting
            waiting = next(pages, None)
            waiting = waiting and _Page(waiting)
            leaf = tree.top()
        if leaf < 0:
            return
        rank += 1
        yield (*opened[leaf].take(), rank)
        tree.put(leaf, opened[leaf].key())
    rest = [p for p in opened.values()] + ([waiting] if waiting else [])
    for page in rest:
        while page.key():
            yield (*page.take(), None)
    for row in pages:
        page = _Page(row)
        while page.key():
            yield (*page.take(), None)


PAGES = "range int, run long, page long, n long, scores array<long>, ids array<long>, ties array<long>, counts array<long>, weights array<long>"
LISTS = ("scores", "ids", "ties", "counts", "weights")


def _keys(b: pa.RecordBatch) -> list[tuple]:
    return [_key(*r) for r in zip(b.column("score").to_pylist(), b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), strict=True)]


def _splitters(runs: DataFrame, eligible: int, draw: int, wanted: int) -> list[tuple]:
    """Keys that cut the drawn rows into about ``wanted`` ranges, from every ``step``-th row of all runs; the last lies after all drawn rows."""
    step = max(1, eligible // MARKS)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        skip = (run * 7919) % step  # runs start at different places
        for b in batches:
            at = np.arange(skip, b.num_rows, step)
            skip = (skip - b.num_rows) % step
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("score", "doc_id", "tie")), pa.array([run] * len(at), pa.int64())], ["score", "doc_id", "tie", "run"])

    found = runs.mapInArrow(marks, "score long, doc_id long, tie long, run long").collect()
    keys = sorted(_key(r.score, r.doc_id, r.tie) for r in found)
    keys = keys[: draw // step + len({r.run for r in found}) + 2]
    return sorted({keys[(k + 1) * len(keys) // wanted - 1] for k in range(wanted) if (k + 1) * len(keys) // wanted})


def ranked(rows: DataFrame, folder: str, share: int = SHARE) -> DataFrame:
    """(doc_id, tie, n_features, weight, score, rank): ``share`` in a hundred of the eligible rows have ranks, the others null."""
    columns = ["doc_id", "tie", "n_features", "weight", "score"]
    runs = rows.where("eligible").select(*columns).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    eligible = rows.where("eligible").count()
    draw = share * eligible // 100
    parts = partitions(rows.sparkSession)
    cuts = _splitters(runs, eligible, draw, max(1, min(parts, -(-draw // RANGE_ROWS) * 4))) if draw else []

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, page = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = _keys(b)
            edges = [0, *(bisect.bisect_right(keys, c) for c in cuts), len(keys)]
            made = [(r, a, min(a + PAGE, edges[r + 1])) for r in range(len(edges) - 1) for a in range(edges[r], edges[r + 1], PAGE)]
            sizes = [z - a for _, a, z in made]
            offsets = pa.array([0, *np.cumsum(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, b.column(c)) for c in ("score", "doc_id", "tie", "n_features", "weight")]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([run] * len(made), pa.int64()), pa.array(range(page, page + len(made)), pa.int64()), pa.array(sizes, pa.int64()), *lists], ["range", "run", "page", "n", *LISTS])
            page += len(made)

    pages = stored(runs.mapInArrow(paged, PAGES), folder, "pages")
    counts = {r.range: r.n for r in pages.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row per range
    before, total = {}, 0
    for r in sorted(counts):
        before[r], total = total, total + counts[r]
    wanted = [r for r in before if before[r] < draw]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            at, following = row["range"], []

            def own(row=row, at=at, following=following) -> Iterator[dict]:
                while row is not None and row["range"] == at:
                    yield row
                    row = next(rows, None)
                following.append(row)

            out = []
            for x in merged(own(), before[at], draw):
                out.append(x)
                if len(out) == PAGE:
                    yield _ranked_batch(out)
                    out = []
            if out:
                yield _ranked_batch(out)
            row = following[0]

    first = [F.get("scores", F.lit(0)).desc(), F.get("ids", F.lit(0)).asc_nulls_last(), F.get("ties", F.lit(0))]
    near = pages.where(F.col("range") <= max(wanted, default=-1)).repartition(max(1, min(parts, len(wanted))), "range").sortWithinPartitions("range", *first, "run", "page")
    drawn = near.mapInArrow(merge, "doc_id long, tie long, n_features long, weight long, score long, rank long")
    zipped = F.explode(F.arrays_zip("ids", "ties", "counts", "weights", "scores")).alias("z")
    far = pages.where(F.col("range") > max(wanted, default=-1)).select(zipped).select(*(F.col(f"z.{c}").alias(n) for c, n in zip(("ids", "ties", "counts", "weights", "scores"), columns, strict=True)), F.lit(None).cast("long").alias("rank"))
    out = rows.where("not eligible").select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(far).unionByName(out)


def _ranked_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "tie", "n_features", "weight", "score", "rank"])


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_run: int = LEAST_RUN, most_run: int = MOST_RUN, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, n_features, weight, score, rank) of all documents; both tables have a column ``text``."""
    folder = shared_folder(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets, least_run, most_run), bucket_counts(target, buckets, least_run, most_run))
    rows = stored(scored(docs, gain, least_run, most_run, least_words, seed), folder, "scored")
    return ranked(rows, folder, share)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns.

    Rows of one doc_id and text are drawn together, but for the one such pair at
    which the count may end, of whose rows any as many are taken.
    """
    columns = docs.columns
    ranks = stored(importance_ranks(docs.select("doc_id", "text"), target, **options), shared_folder(docs.sparkSession), "ranks")
    drawn = ranks.where("rank is not null").groupBy(F.col("doc_id").alias("d_"), F.col("tie").alias("t_")).agg(F.count("*").alias("n_"))
    last = ranks.where("rank is not null").orderBy(F.desc("rank")).select("doc_id", "tie", "score").first()
    if last is None:
        return docs.limit(0)
    here = F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long")) & (F.col("tie") == last.tie)
    partial = not ranks.where(here & F.col("rank").isNull()).isEmpty()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    whole = drawn.where(~(F.col("d_").eqNullSafe(F.lit(last.doc_id).cast("long")) & (F.col("t_") == last.tie))) if partial else drawn
    out = row.join(whole, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tie") == F.col("t_")), "left_semi")
    if partial:
        out = out.unionByName(row.where(here).limit(ranks.where(here & F.col("rank").isNotNull()).count()))
    return out.select("row_.*")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_ranks(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH
steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
b AS (
  SELECT word, xor(list_reduce(
           list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
           lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM words, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + {BUCKETS} AS DOUBLE)
           / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bw) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST((total - ((total % n) + n) % n) / n AS BIGINT) END AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM w),
k AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place,
         (SELECT count(*) FROM z WHERE n_features >= {LEAST_WORDS}) AS eligible
  FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * eligible // 100 THEN place END AS rank FROM k"""
