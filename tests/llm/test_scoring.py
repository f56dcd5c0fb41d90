"""Toxicity, vector codes and importance resampling: against plain versions, SQL, held-out labels, and awkward rows."""

import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import duck, rows_of

from tallymix.llm import catalog, resampling, toxicity, vector_codes
from tallymix.llm.common import flat_text, shared_folder, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "   \n\t", "en", "a", 5), (4, "one", "en", "a", 3),
    (5, "same words here in this text line " * 4, "en", "b", 33), (5, "same words here in this text line " * 4, "en", "b", 33), (6, "same words here in this text line " * 4, None, "b", 33),
    (None, "a row without an id but with words enough " * 3, "en", None, 41), (None, "a row without an id but with words enough " * 3, "en", None, 41),
    (7, "ÄÖ ñandú 한국어 \U0001f600 ≠ x", "de", "c", 20), (8, "long " * 30000, "en", "a", 150000), (9, "x" * 9000 + " tail", "en", "a", 9005),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "extra", 7) for r in AWKWARD], DOCS + ", score string, rank int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_importance_resampling"])
def test_queries_agree_with_sql(spark, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck(sf).execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if "rank" in got:
        got, want = got.astype({"rank": float}), want.astype({"rank": float})  # with nulls, which the two tell apart
    assert rows_of(got) == rows_of(want)


# --- toxicity


def plain_features(text: str) -> set:
    """Kinds and words of the features that the model hashes."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {(k, *(words[i + p] for p in places)) for k, places in enumerate(toxicity.KINDS) for i in range(len(words) - places[-1])}


def test_features_are_those_of_each_text():
    """Texts with equal feature sets have equal hashes, others don't share more than they should."""
    texts = ["The cat, the CAT sat!", "the cat the cat sat", "a b c d e", "", None, "e d c b a", "x", "ñandú é ñandú"]
    found = toxicity.distinct_features(*flat_text(pa.array(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(found[i], found[j])) == len(plain_features(a) & plain_features(b))


def plain_ftrl(rows, y, size, epochs, alpha, beta, l1, l2, seed):
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(j):
        p1, p2 = (0.0, 0.0) if j == size else (l1, l2)
        return 0.0 if abs(z[j]) <= p1 else (math.copysign(p1, z[j]) - z[j]) / ((beta + math.sqrt(n[j])) / alpha + p2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            w = {j: weight(j) for j in rows[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for j in rows[i]:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * w[j]
                n[j] += g * g
    return [weight(j) for j in range(size + 1)]


def test_ftrl_equals_plain():
    rng = np.random.default_rng(2)
    rows = [np.append(np.flatnonzero(rng.random(9) < 0.4), 9) for _ in range(60)]
    y = np.array([float(0 in r or rng.random() < 0.1) for r in rows])
    for l1, l2 in ((1.0, 0.5), (3.0, 0.0)):
        got = toxicity.ftrl(rows, y, 9, 4, 0.7, 1.0, l1, l2, 3)
        assert np.allclose(got, plain_ftrl([r.tolist() for r in rows], y, 9, 4, 0.7, 1.0, l1, l2, 3))
    assert (got[:-1] == 0).any()  # the penalty leaves weights out


def test_scores_are_sums_over_distinct_features(monkeypatch):
    """Whole texts, however they are cut for looking up."""
    texts = ["you silly goose", "you you silly silly", "goose", "", None, "fine words " * 500 + "silly goose"]
    found = toxicity.distinct_features(*flat_text(pa.array(texts)))
    hashes = np.unique(np.concatenate([found[0], found[2]]))
    weights = np.linspace(-1, 1, len(hashes))
    model = toxicity.ToxicityModel(hashes, weights, -0.25)
    want = [1 / (1 + math.exp(-(-0.25 + sum(weights[np.searchsorted(hashes, h)] for h in f if h in set(hashes.tolist()))))) for f in found]
    assert np.allclose(model.scores(pa.array(texts)), want)
    monkeypatch.setattr(toxicity, "LOOKED_UP", 7)
    assert np.allclose(model.scores(pa.array(texts)), want)


def labelled(spark, n=900):
    rng = np.random.default_rng(6)
    words, bad = [f"w{i}" for i in range(300)], ["grunk", "zorp", "blarg"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [words[j] for j in rng.integers(0, 300, rng.integers(5, 60))], int(rng.random() < 0.25)
        if toxic:
            text.insert(int(rng.integers(0, len(text))), bad[int(rng.integers(0, 3))] + "!")
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, None, toxic if i % 7 else None))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels(spark):
    docs, labels = labelled(spark)
    known = labels.where("doc_id % 3 <> 1")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = [r for r in labels.where("doc_id % 3 = 1 and toxic is not null").collect()]
    assert np.mean([(got[r.doc_id] >= 0.7) == r.toxic for r in held]) > 0.97
    assert not [r for r in held if not r.toxic and got[r.doc_id] >= 0.7]


def test_the_sample_is_bounded(spark):
    """Fewer code points or rows fit on fewer texts; the model still answers."""
    docs, labels = labelled(spark, 300)
    for options in ({"most": 3000}, {"wanted": 20}, {"most": 1}):
        scores = [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, **options)).collect()]
        assert len(scores) == 300 and all(0 <= s <= 1 for s in scores)


def test_toxicity_awkward(spark, awkward, empty):
    _, labels = labelled(spark, 60)
    out = toxicity.score(awkward, toxicity.fit(awkward, labels))
    assert out.columns == [*(c for c in awkward.columns if c != "score"), "score"] and out.count() == len(AWKWARD)
    scores = {}
    for r in out.collect():
        scores.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    none = toxicity.fit(awkward, labels.limit(0))
    assert {r.score for r in toxicity.score(awkward, none).collect()} == {0.5}
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    ones = labels.withColumn("toxic", labels.doc_id * 0 + 1)
    assert all(r.score > 0.5 for r in toxicity.score(awkward, toxicity.fit(awkward, ones)).where("text <> ''").collect())


def test_toxicity_query(spark, sf):
    rows = catalog.queries()["op11_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


# --- vector codes


def plain_encode(rows, parts, entries, rounds):
    """Codes, errors and codebooks over all entries, in Python's whole numbers."""
    kept = sorted((r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept if len(v) == len(kept[0][1])]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine: dict[int, list] = {}
            for c in cut:
                mine.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)) if j in mine else e for j, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, label, tuple(j for _, j in f), sum(d for d, _ in f)) for (i, _, label), f in zip(kept, found, strict=True)], books


VECTORS = "vec_id long, embedding array<float>, label int, extra string"


@pytest.mark.parametrize("case", ["spread", "copies and ties", "few", "negative"])
def test_codes_equal_plain(spark, case):
    rng = np.random.default_rng(4)
    x = {"spread": rng.normal(size=(300, 8)), "copies and ties": np.round(rng.normal(size=(200, 8))) / 256, "few": rng.normal(size=(5, 8)), "negative": -np.abs(rng.normal(size=(120, 8))) * 40}[case]
    rows = [(int(i), [float(np.float32(v)) for v in row], int(i) % 3 if i % 5 else None) for i, row in zip(rng.permutation(len(x)), x, strict=True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    got, book = vector_codes.encode(df, parts=4, entries=16, rounds=2)
    want, books = plain_encode(rows, 4, 16, 2)
    assert sorted((r.vec_id, tuple(np.frombuffer(r.code, "<u2").tolist()), r.error) for r in got.collect()) == sorted((i, code, error) for i, _, code, error in want)
    assert book.entries.tolist() == [[list(e) for e in b] for b in books]


def test_search_is_exact_from_any_start():
    """Whatever entry the search starts at, and with equal entries in the codebook."""
    rng = np.random.default_rng(9)
    entries = rng.integers(-40, 40, (3, 20, 2))
    entries[:, 7] = entries[:, 3]
    book = vector_codes.Codebook(entries)
    x = rng.integers(-50, 50, (400, 6))
    want = ((x.reshape(400, 3, 1, 2) - entries[None]) ** 2).sum(-1)
    for start in (np.zeros((400, 3), int), rng.integers(0, 20, (400, 3)), np.full((400, 3), 7)):
        got, square = book.nearest(x, start)
        assert np.array_equal(got, want.argmin(-1)) and np.array_equal(square, want.min(-1))


def test_vectors_awkward(spark):
    good = [(i, [float(i), 1.5, -2.25, 0.1 * i], i % 2) for i in range(6)]
    bad = [(10, None, 1), (11, [], 1), (12, [1.0, None, 2.0, 3.0], 1), (13, [float("nan"), 0.0, 0.0, 0.0], 1), (14, [float("inf"), 0.0, 0.0, 0.0], 1), (15, [1.0, 2.0, 3.0], 1), (16, [1.0, 2.0], 1), (17, [1e30, 0.0, 0.0, 0.0], 0)]
    rows = [*good, (None, [9.0, 9.0, 9.0, 9.0], None), (2, [2.0, 1.5, -2.25, 0.2], 0), *bad]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    coded, book = vector_codes.encode(df, parts=2, entries=3)
    out = vector_codes.with_label_error(coded)
    got = out.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, i) for i in (0, 1, 2, 2, 3, 4, 5)] + [(True, 0)]
    sums: dict = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    x = np.floor(256 * np.array([9.0] * 4))
    last = next(r for r in out.select("vec_id", vector_codes.hex_code("code").alias("code"), "error").collect() if r.vec_id is None)
    assert ((vector_codes.decoded(last.code, book) - x) ** 2).sum() == last.error
    none, book = vector_codes.encode(df.limit(0), parts=2)
    assert none.count() == 0 and book is None and vector_codes.with_label_error(none).count() == 0


def test_label_sums_by_both_joins(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 4)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else str(i % 40), i) for i in range(600)], "vec_id long, label string, error long")
    want: dict = {}
    for r in df.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    got = vector_codes.with_label_error(df).collect()
    assert len(got) == 600 and all(r.label_error == want[r.label] for r in got)


# --- importance resampling


def words_of(text, least=1, most=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def plain_ranks(docs, target, buckets=10000, least=1, most=1, words=20, share=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for f in words_of(text, least, most)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, features = words_of(text, least, most)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= words))
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {}
    for rank, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        drawn.setdefault(r, []).append(rank)
    return sorted([(*r[:4], drawn[r].pop(0) if drawn.get(r) else None) for r in out], key=repr)


def ranks_of(df):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("options", [{}, {"share": 100}, {"share": 0}, {"least_run": 1, "most_run": 3, "buckets": 97, "least_words": 1, "share": 35}])
def test_ranks_equal_plain(spark, awkward, monkeypatch, options):
    """Awkward and repeated rows and a few hundred others, in many pages, ranges and runs."""
    monkeypatch.setattr(resampling, "PAGE", 7)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 16)
    rng = np.random.default_rng(3)
    vocabulary = [f"wörd{i}" if i % 9 == 0 else f"w{i}" for i in range(80)]
    text = lambda low: " ".join(vocabulary[j] for j in rng.integers(low, 80, rng.integers(0, 60)))
    docs = [(r[0], r[1]) for r in AWKWARD] + [(100 + i, text(0)) for i in range(300)] + [(None, "many times the same row " * 5)] * 40
    target = [(i, text(50)) for i in range(30)] + [(99, None)]
    short = {"share": "share", "least_words": "words", "least_run": "least", "most_run": "most", "buckets": "buckets"}
    got = resampling.importance_ranks(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "item_id long, text string"), **options)
    assert ranks_of(got) == plain_ranks(docs, target, **{short[k]: v for k, v in options.items()})


def test_checksums_of_spans():
    data = np.frombuffer(bytes(range(256)) * 40, np.uint8)
    rng = np.random.default_rng(1)
    start = rng.integers(0, 4000, 50)
    size = np.append(rng.integers(0, 300, 48), [5000, 6000])
    assert resampling.crc32_spans(data, start, size).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]


def test_tournament_merges_like_a_heap():
    rng = np.random.default_rng(8)
    runs = [sorted((int(x), j) for x in rng.integers(0, 50, rng.integers(0, 30))) for j in range(37)]
    tree, left, out = resampling.Tournament(2), {}, []
    for run in runs:
        if run:
            left[tree.enter(run[0])] = run[1:]
    while (leaf := tree.top()) >= 0:
        out.append(tree.keys[leaf])
        tree.put(leaf, left[leaf][0] if left[leaf] else None)
        left[leaf] = left[leaf][1:]
    assert out == list(heapq.merge(*runs))


def test_merge_stops_at_the_count():
    """Pages come in the order of their first keys; after the count the rest has no rank."""
    pages = [{"scores": [9, 5, 1], "ids": [1, 2, 3], "ties": [0] * 3, "counts": [1] * 3, "weights": [1] * 3}, {"scores": [8, 7], "ids": [4, None], "ties": [0] * 2, "counts": [1] * 2, "weights": [1] * 2}, {"scores": [6], "ids": [6], "ties": [0], "counts": [1], "weights": [1]}]
    got = list(resampling.merged(iter(pages), 10, 13))
    assert [(r[0], r[-1]) for r in got[:3]] == [(1, 11), (4, 12), (None, 13)]
    assert sorted((r[0], r[-1]) for r in got[3:]) == [(2, None), (3, None), (6, None)]


def test_resample_gives_the_drawn_rows(spark, awkward, empty):
    target = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    ranks = resampling.importance_ranks(awkward, target, share=50)
    out = resampling.resample(awkward, target, share=50)
    assert out.columns == awkward.columns
    drawn = sorted([r.doc_id or -1 for r in ranks.where("rank is not null").collect()])
    assert sorted([r.doc_id or -1 for r in out.collect()]) == drawn and len(drawn) == 50 * 7 // 100
    assert resampling.importance_ranks(empty, target).count() == 0 and resampling.resample(empty, target).count() == 0
    assert resampling.importance_ranks(awkward, target.limit(0)).count() == len(AWKWARD)


def test_equal_scores_in_one_hot_key(spark):
    """A third of the rows with one score and no id: ranks are 1 to n, each once, over several ranges."""
    rows = spark.range(9000).selectExpr("case when id % 3 = 0 then null else id end as doc_id", "0L as tie", "30L as n_features", "5L as weight", "case when id % 3 = 0 then 700L else id % 1000 end as score", "true as eligible")
    out = resampling.ranked(stored(rows.repartition(6), shared_folder(spark), "rows"), shared_folder(spark), 60)
    got = out.where("rank is not null").select("rank", "score").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5401)) and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False))
    assert out.count() == 9000
