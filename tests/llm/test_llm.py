"""The corpus operators against brute force, exact round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import duck, rows_of
from pyspark.sql import functions as F

from tallymix.llm import audio, catalog, common, fingerprints, jaccard_join, language, line_dedup, mixing, packing, private, quality, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, "   \n\t", "en", "a", 5),
    (4, "one", "en", "a", 3),
    (5, "same words here in this text line", "en", "b", 33),
    (5, "same words here in this text line", "en", "b", 33),
    (6, "same words here in this text line", None, "b", 33),
    (None, "a row without an id but with words enough", "en", None, 41),
    (7, "ÄÖ ñandú 한국어 \U0001f600 ≠ x", "de", "c", 20),
    (8, "long " * 30000, "en", "a", 150000),
    (9, "\n\n\n", "en", "a", 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "extra") for r in AWKWARD], DOCS + ", component_id string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table_folder(tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def lower(t):
    return re.sub("[A-Z]", lambda c: c[0].lower(), t or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            n = len(x & y)
            if n and 100 * n >= 75 * (len(x) + len(y) - n):
                parent[root(a)] = root(b)
    names = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            names[root(k)] = min(i, names.get(root(k), i))
    return sorted(((i, len(s), names.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def got_components(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


# --- SQL ---


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck(sf).execute(catalog.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


# --- common ---


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = {"".join(rng.choice("heor") for _ in range(rng.randint(1, 9))) for _ in range(5000)}
    data, offs = common.flat_text(pa.array([" ".join(words)]))
    ws, _ = common.word_spans(data, offs)
    assert len(ws) == len(words) == len(set(common.word_hashes(data, ws).tolist()))


def test_shingles_count_like_sets():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "d\n", "\te"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x", "ab cd", "A B C D E"]
    got = [len(s) for s in common.shingles(*common.flat_text(pa.array(texts, pa.string())))]
    assert got == [len(shingle_set(t)) for t in texts]
    whole = list(common.shingles(*common.flat_text(pa.array(["p q r s t u", "P Q R S T U"]))))
    assert np.array_equal(*whole)


@pytest.mark.parametrize("few", [common.FEW_LINKS, 3])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 30)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "u long, v long").repartition(4), common.shared_folder(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# --- op 1 ---


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    base = [word() for _ in range(60)]
    for _ in range(45):  # a long list: copies of copies, many of them not near each other
        base = list(base)
        base[rng.randrange(60)] = word()
        rows.append((k, " ".join(base)))
        k += 1
    passage = [word() for _ in range(50)]
    for _ in range(30):  # a common passage in texts that aren't near
        rows.append((k, " ".join([word() for _ in range(60)] + passage)))
        k += 1
    for n in range(3, 16):  # small sets around the boundary
        small = [word() for _ in range(n + 4)]
        rows += [(k, " ".join(small)), (k + 1, " ".join(small[:-1])), (k + 2, " ".join(small + [word()])), (k + 3, " ".join(small).upper())]
        k += 4
    rng.shuffle(rows)
    return rows


def test_join_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_components(jaccard_join.near_duplicates(df)) == brute_components(rows)


def test_join_awkward(awkward, empty):
    assert got_components(jaccard_join.near_duplicates(awkward)) == brute_components([r[:2] for r in AWKWARD])
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("level", [14, 20])
def test_dealt_cells_lose_no_link(spark, level):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder, levels = common.shared_folder(spark), np.full(1 << 16, level, np.uint8)
    sets = jaccard_join.set_table(docs, folder)
    found = {common.set_key(s): s for s in common.shingles(*common.flat_text(pa.array([t for _, t in rows]))) if len(s) >= jaccard_join.LEAST}
    entries = np.concatenate([e for k, s in found.items() for e in jaccard_join.entries_of(k, s, levels, jaccard_join.LEAST - 1)])
    assert len(set(entries["cell"].tolist())) > 1
    index = spark.createDataFrame([(b, entries[entries["cell"] % 5 == b].tobytes()) for b in {*(entries["cell"] % 5).tolist()}], "bucket int, data binary")
    _, linked = jaccard_join.links_of_index(index, docs, sets, jaccard_join.LEAST - 1, folder)
    assert got_components(jaccard_join.named_components(sets, linked, folder)) == brute_components(rows)


def test_levels_bound_document_counts(spark):
    rng = random.Random(18)
    rows = [(k, " ".join(rng.choice(["often", "some", "rare", "x" + str(rng.randrange(300))]) for _ in range(rng.randint(7, 40)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingle_levels, word_levels, _ = jaccard_join.document_levels(docs, 3000)
    sets, words = Counter(), Counter()
    per_text = {t: (list(common.shingles(*common.flat_text(pa.array([t]))))[0], np.unique(common.words_of(*common.flat_text(pa.array([t])))[0])) for _, t in rows}
    for s, w in per_text.values():
        sets.update(s.tolist())
        words.update(w.tolist())
    for counts, table in ((sets, shingle_levels), (words, word_levels)):
        h = np.array(list(counts), np.uint64)
        assert all(table[k] >= int(np.log2(n)) for k, n in zip(jaccard_join.slot_of(h, table), counts.values(), strict=True))


def test_order_by_words_alone(spark, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 4)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 4)  # a table that says nothing, as where shingles fill it
    assert got_components(jaccard_join.near_duplicates(df)) == brute_components(rows)


def test_hidden_clusters_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 1 << 12)
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, rows = [word() for _ in range(40)], []
    for k in range(12):  # groups that share a passage and are near within themselves only
        own = [word() for _ in range(30)]
        for j in range(12):
            own[j % 30] = word() if j % 3 == 0 else own[j % 30]
            rows.append((100 * k + j, " ".join(shared + own)))
    rows += [(5000 + k, " ".join(shared + [word() for _ in range(30)])) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_components(jaccard_join.near_duplicates(df)) == brute_components(rows)


def test_rounds_end_or_raise(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    monkeypatch.setattr(common, "ROUNDS", 2)
    monkeypatch.setattr(common, "TREES", 2)
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long").repartition(16)
    with pytest.raises(RuntimeError):
        common.components(links, common.shared_folder(spark))


def test_boundary_by_cost():
    assert jaccard_join.boundary({}, 1.0) >= jaccard_join.LEAST - 1
    few, many = jaccard_join.boundary(dict.fromkeys(range(3, 65), 10), 1.0), jaccard_join.boundary(dict.fromkeys(range(3, 65), 10), 20.0)
    assert few < many


# --- op 2 ---


def test_quality_held_out(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    got = quality.op2_quality(spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    out = got.toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").toPandas(), on="doc_id")
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and r.predicted == (r.score >= 0.3) for r in out.itertuples())
    out = out[out.held_out & out.quality.notna()]
    good, bad = out.score[out.quality == 1], out.score[out.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.95 and (out.predicted == out.quality).mean() > 0.9


def test_quality_does_not_depend_on_partitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(5), labels)
    assert np.array_equal(one.vectors, two.vectors) and np.allclose(one.network.weights[0], two.network.weights[0])


def test_neighbours_equal_plain(spark, monkeypatch):
    texts = ["a b c a b", "x", "", "b c d. E f7 a a a", None, "c " * 50]
    index = quality.index_vectors()
    sums, seen = np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros(quality.BUCKETS)
    for t in texts:
        for b in quality.word_buckets(*common.flat_text(pa.array([t or ""])))[:2]:
            for i in range(len(b)):
                for j in range(max(0, i - quality.WINDOW), min(len(b), i + quality.WINDOW + 1)):
                    if j != i:
                        sums[b[i]] += index[b[j]]
                        seen[b[i]] += 1
    got = quality.random_indexing(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, quality.word_vectors(sums, seen))
    big = np.array([[0, -40000], [1 << 40, 3]])
    assert np.array_equal(quality._unpacked(quality._packed(big), big.shape), big)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(2, 0), (4, 1), (5, 1), (77, None)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    scores = [r.score for r in quality.score(awkward, model).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    none = quality.fit(empty, labels.where("false"))
    assert {r.score for r in quality.score(awkward, none).collect()} == {0.5} and quality.score(empty, none).count() == 0


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert quality.temperature(3 * logits, y) == pytest.approx(3, rel=0.2)


# --- op 3 ---


def test_mix_takes_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), None, ("a", "b", "c", None)[min(3, int(rng.random() * 5))], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    drawn = mixing.copies(df).withColumn("taken", F.col("copies") * F.col("size")).toPandas()
    for (size, target), g in drawn.groupby(["source_size", "target"]):
        assert g.taken.sum() == pytest.approx(target, rel=0.02) and target <= 2 * size
    assert (drawn.taken <= 2 * drawn["size"]).all()
    again = mixing.copies(df.repartition(7)).toPandas()
    assert dict(zip(drawn.doc_id, drawn.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))
    assert drawn.drop_duplicates("target").target.sum() == pytest.approx(1.5 * drawn["size"].sum())


def test_targets_reshare(spark):
    rows = mixing.target_sizes(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")).collect()
    got = {r.source: r.target for r in rows}
    rest = 1.5 * 2010 - 20
    assert got["a"] == 20 and got[None] == 0 and got["b"] == pytest.approx(rest / 3) and got["c"] == pytest.approx(2000 if rest * 2 / 3 > 2000 else rest * 2 / 3)


def test_mix_awkward(awkward, empty):
    assert mixing.copies(awkward).count() == len(AWKWARD)
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns and out.count() > 0
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


# --- op 4 ---


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and private.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("12 .@-+a()9\nb0") for _ in range(rng.randint(0, 60)))
        assert private.base_spans(t) == plain_spans(t)
    t = "card 4111 1111-1111 1111 and joe.x@mail.example.com, 10.0.0.300 10.0.0.30"
    assert private.base_spans(t) == plain_spans(t) and len(plain_spans(t)) == 3


def test_gradients_equal_differences():
    tagger, (codes, tags) = private.Tagger(1), private.windows_of(private.labelled_texts(2, 5))
    codes, tags = codes[:2, :12], tags[:2, :12]
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.gradients(codes, tags)
    for name in tagger.p:
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        keep, ends = tagger.p[name][at], []
        for d in (1e-2, -1e-2):
            tagger.p[name][at] = keep + d
            ends.append(tagger.gradients(codes, tags)[0])
        tagger.p[name][at] = keep
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-3)


def test_tagger_adds_what_patterns_miss():
    tagger = private.default_tagger()
    text = "the anor (266) 555-7228 ther " + "and the ortion " * 40 + "mail joe.smith (at) example.org please"
    added = private.added_spans([text], [[]], tagger)[0]
    assert {(k, text[a:b]) for k, a, b in added} == {("phone", "(266) 555-7228"), ("email", "joe.smith (at) example.org")}
    assert private.added_spans(["no marks at all here", 'token = "3e5cb3f9186ce4f749644b4847d287be561795be" 303453'], [[], []], tagger) == [[], []]


class EveryAllowedPlace:
    """Stands for a tagger that tags all it may."""

    def decode(self, codes, allowed):
        path = np.where(allowed[:, :, 1], 1, np.where(allowed[:, :, 4], 4, 0))
        return path, np.ones(codes.shape, np.float32)


def test_spans_of_any_length_stay_whole():
    for n in (1, 20, 40, 60, 100, 300, 1000):
        for lead in (0, 7, 40, 95):
            text = "m" * lead + " " + "a" * n + " (at) example" + ".x" * n + ", 030/1234 56789 end"
            got = {(k, text[a:b]) for k, a, b in private.added_spans([text], [[]], EveryAllowedPlace())[0]}
            assert got == {("email", text[lead + 1 : text.index(",")]), ("phone", "030/1234 56789")}


def test_held_out_spans_by_kind():
    tagger, texts = private.default_tagger(), private.labelled_texts(700, 99)
    base = [private.base_spans(t) for t, _ in texts]
    added = private.added_spans([t for t, _ in texts], base, tagger)
    for kind in private.KINDS:
        want = {(n, *s) for n, (_, spans) in enumerate(texts) for s in spans if s[0] == kind}
        got = {(n, *s) for n, spans in enumerate(added) for s in spans if s[0] == kind}
        have = got | {(n, *s) for n, spans in enumerate(base) for s in spans if s[0] == kind}
        assert len(want & have) >= 0.9 * len(want) > 50, kind
        assert len(got & want) >= 0.9 * len(got), kind


def plain_decode(e, allowed, moves, first):
    """The best path by trying, for each tag, all that come before."""
    e = np.where(allowed, e, private.MASKED)
    best = [(first[j] + e[0, j], [j]) for j in range(e.shape[1])]
    for t in range(1, len(e)):
        best = [max(((v + moves[i, j] + e[t, j], [*p, j]) for i, (v, p) in enumerate(best)), key=lambda x: x[0]) for j in range(e.shape[1])]
    return max(best, key=lambda x: x[0])[1]


def test_masked_decoding_equals_plain():
    tagger, rng = private.default_tagger(), np.random.default_rng(3)
    codes = private.windows_of(private.labelled_texts(5, 7))[0][:6]
    allowed = rng.random((*codes.shape, private.TAGS)) < 0.7
    allowed[:, :, 0] = True
    path, _ = tagger.decode(codes, allowed)
    e = tagger.emissions(codes)
    for k in range(len(codes)):
        assert path[k].tolist() == plain_decode(e[:, k].astype(float), allowed[k], tagger.p["moves"], tagger.p["first"])


def test_windows_cover_each_character_once():
    for length in (0, 1, private.WINDOW - 1, private.WINDOW, private.WINDOW + 1, 500, 1000):
        last = max(0, -(-(length - private.WINDOW) // private.STEP))
        cut = [private.middle(k, last, length) for k in range(last + 1)]
        assert cut[0][0] == 0 and cut[-1][1] == length and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
        assert all(k * private.STEP <= a <= b <= k * private.STEP + private.WINDOW for k, (a, b) in enumerate(cut))


def test_very_long_numbers():
    for t in ("0" * 5000 + "1.2.3.4", "9" * 5000 + ".2.3.4", "1" * 9000, "(" * 9000 + "+" * 9000 + "@" * 9000, "1.2.3." + "0" * 6000 + "255"):
        assert private.base_spans(t) == [s for s in plain_long_spans(t)]
        private.added_spans([t], [private.base_spans(t)], private.default_tagger())


def plain_long_spans(t):
    ok = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
    return [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(ok(x) for x in m[0].split("."))]


def test_private_awkward(spark, awkward, empty):
    rows = private.find_private(awkward.union(awkward.limit(1).select(F.lit(11).cast("long"), F.lit("a@b.de x"), "lang", "source", "n_chars", "component_id"))).collect()
    assert {r.doc_id: r.redacted for r in rows}[11] == "[EMAIL] x" and {r.doc_id: r.spans for r in rows}[1] == []
    assert private.find_private(empty).count() == 0


# --- op 5 ---


def test_likeness_estimates_jaccard():
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(300)]
    for cut in (0, 30, 150):
        other = base[:cut] + [str(rng.random()) for _ in range(300 - cut)]
        a, b = fingerprints.signatures_of([" ".join(base), " ".join(other)])
        x, y = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        assert fingerprints.likeness(a, b) == pytest.approx(len(x & y) / len(x | y), abs=0.2)


def plain_followers(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        new = t[: len(t) - k] + n[:k]
        a, b, c = fingerprints.signatures_of([t, new, n])
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.hexadecimal(a), fingerprints.hexadecimal(b), float(fingerprints.likeness(a, b)), float(fingerprints.likeness(a, c))))
    return Counter(out)


def follower_rows():
    rng = random.Random(7)
    rows = [(i, f"text {i} " * (i % 7)) for i in rng.sample(range(10**9), 300)] + [(5, None), (2**62, "far away"), (-(2**62), "on the other side")]
    rows += [(None, f"{rng.random()} no id at all") for _ in range(200)] + [(77, f"é{rng.random()} one id") for _ in range(100)]
    return rows + [(78, "the same text for all") for _ in range(60)] + [(None, "the same text for all") for _ in range(40)]


@pytest.mark.parametrize("cell_bytes", [1 << 10, 1 << 24])
def test_followers(spark, cell_bytes):
    rows = follower_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.with_followers(docs, fingerprints.near_duplicates(docs), cell_bytes).drop("component_id")
    assert Counter(map(tuple, got.collect())) == plain_followers(rows)


def test_cells_spread_whatever_the_ids_are(spark):
    rows = follower_rows() + [(10**18 + 1, "an outlier")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cells = fingerprints.cells_of(docs, 256)
    packs = fingerprints.packed(docs, cells).collect()
    sizes = Counter()
    for r in packs:
        sizes[r.cell] += sum(pa.ipc.open_stream(bytes(r["data"])).read_all().column("n").to_pylist())
    assert sum(sizes.values()) == len(rows) and len(sizes) == len(cells) and len(cells) > 30
    assert sum(n > 60 for n in sizes.values()) <= 1 and max(sizes.values()) < 150


def test_fingerprints_name_components(spark, sf):
    got = fingerprints.op5_fingerprints(spark, sf).toPandas()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: c for i, _, c in brute_components(rows)}
    right = sum(want[r.doc_id] == r.component_id for r in got.itertuples())
    assert len(got) == len(rows) and right >= 0.98 * len(rows)
    linked = [r for r in got.itertuples() if want[r.doc_id] != r.doc_id]
    assert sum(want[r.doc_id] == r.component_id for r in linked) >= 0.95 * len(linked) > 0


def test_fingerprints_awkward(spark, awkward, empty, tmp_path):
    got = fingerprints.op5_fingerprints(spark, table_folder(tmp_path, awkward)).collect()
    assert len(got) == len(AWKWARD)
    same = {r.fingerprint for r in got if r.doc_id in (5, 6)}
    assert len(same) == 1
    assert fingerprints.op5_fingerprints(spark, table_folder(tmp_path, empty)).count() == 0
    assert fingerprints.op5_fingerprints(spark, table_folder(tmp_path, awkward.where("doc_id = 4"))).count() == 1


def test_bands_find_near_copies(spark):
    rng = random.Random(8)
    base = [[str(rng.random())[:6] for _ in range(80)] for _ in range(20)]
    rows = [(2 * k, " ".join(b)) for k, b in enumerate(base)] + [(2 * k + 1, " ".join(b[:-2])) for k, b in enumerate(base)]
    assert got_components(fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows)


# --- op 6 ---


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain = Tokenizer.from_file(path)
    texts = ["", "abc| x|y |", "Abc!! don't. it's, ab<|endoftext|> É.. é.,ß% x2. 3.a", "ΑΣ ΟΔΟΣ", "\x1cfoo\x1d bar", "I'LL 123 a_b", "   ", "a\r\nb\tc", "한국어 中文", "İ x̌ e\u0301"]
    rng = random.Random(9)
    texts += ["".join(rng.choice("aB.'|é1 \n-Σ") for _ in range(40)) for _ in range(300)]
    for t, ids in zip(texts, packing.token_ids(texts, path), strict=True):
        assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, packing.END]


def test_ids_of_any_letters_and_marks():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain, rng = Tokenizer.from_file(path), random.Random(14)
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    odd = ["İ", "\u0958", "\u0959", "\u09df", "\u0b5c", "\ufb36", "#", "!", "H\u0331", "\u1e96", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "|", "\u00a0", "\x0b", "'s", "'S", "ſ", "\u212a", "1", "٣"]
    for _ in range(20):
        texts = ["".join(rng.choice(letters) if rng.random() < 0.3 else rng.choice(odd) if rng.random() < 0.5 else rng.choice("abABzZ .,!#'|0") for _ in range(rng.randint(0, 12))) for _ in range(5000)]
        want = [[*e.ids, packing.END] for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in packing.token_ids(texts, path)] == want


def test_packing_spreads_rows_of_one_id(spark):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(600)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = packing.pack(docs, group_rows=50).groupBy(F.shiftright("sequence_id", 32).alias("group")).count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["count"] for r in got) == 600 and max(r["count"] for r in got) < 150


def test_first_fit_decreasing():
    rng = random.Random(10)
    sizes = np.array([rng.randint(1, 100) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for k in np.argsort(-sizes, kind="stable"):
        at = next((j for j, r in enumerate(room) if r >= sizes[k]), len(room))
        room += [100] * (at == len(room))
        assert (bins[k], offsets[k]) == (at, 100 - room[at])
        room[at] -= sizes[k]


def test_packing_whole_and_gapless(spark, awkward, empty):
    got = packing.pack(awkward, group_rows=4).toPandas()
    want = Counter()
    for (i, t, *_), ids in zip(AWKWARD, packing.token_ids([r[1] for r in AWKWARD], packing.vocabulary_path()), strict=True):
        for s in range(0, len(ids), packing.CAPACITY):
            part = ids[s : s + packing.CAPACITY]
            want[i, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= packing.CAPACITY and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    assert packing.pack(empty).count() == 0


# --- op 7 ---


def plain_dedup(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, []).append((r, -(2**63) if i is None else i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        left = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(h[1] for h in held[key(x)]) == own]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


LINES = ["a line that is long enough", "  A line that is LONG enough\t", "short", "", "another line, also long enough", "ééééééééééééééééééé", "éééééééééééééééééééé", "\x0b a line that is long enough \r"]


def line_rows():
    rng = random.Random(11)
    return [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(None, LINES[0]), (None, LINES[0]), (3, LINES[4]), (8, None)]


def test_lines_equal_plain(spark):
    rows = line_rows()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == plain_dedup(rows)


def test_index_is_reversible(spark):
    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    kept, gone = df.where("doc_id is null or doc_id % 3 <> 0").persist(), df.where("doc_id % 3 = 0").persist()
    counts = lambda index: sorted(map(tuple, index.counts.select("h1", "h2", "refs", "keeper").collect()))
    base, whole = line_dedup.LineIndex.build(kept), line_dedup.LineIndex.build(df)
    more = base.insert(gone)
    back = more.delete(gone, kept)
    assert counts(more) == counts(whole) and counts(back) == counts(base)
    for index in (base, more, back):
        filters = {(r.shard, r.piece): line_dedup.Cuckoo.of(bytes(r["filter"])) for r in index.filters.collect()}
        held = sum(int((f.table != 0).sum()) for f in filters.values())
        assert held == index.counts.where(f"refs >= {line_dedup.MIN_DOCS}").count()


def test_one_repeated_line_in_many_pieces(spark):
    pieces = 1280 // line_dedup.SHARDS
    h2 = lambda line: int(line_dedup.line_keys(*common.flat_text(pa.array([line])))[5].view(np.int64)[0])
    line = next(x for x in (f"the only line that is repeated, {k}" for k in range(1000)) if h2(x) % pieces == 7 and h2(x) % 8 != 7)
    rows = [(i, f"{line}\na line of its own in text {i}") for i in range(6)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1280")
    try:
        index = line_dedup.LineIndex.build(docs)
        index = index.insert(docs.where("doc_id < 2")).delete(docs.where("doc_id < 2"), docs)
        for got in (line_dedup.dedup_lines(docs), line_dedup.dedup_lines(docs, index)):
            assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == plain_dedup(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cuckoo():
    keys = common.random_u64(5000, 77)
    f = line_dedup.Cuckoo(keys[:4000])
    assert f.has(keys[:4000]).all() and f.has(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    f.insert(keys[4000:], lambda: keys[2000:])
    assert f.has(keys[2000:]).all() and f.has(keys[:2000]).mean() < 0.01


def test_lines_awkward(awkward, empty):
    got = line_dedup.dedup_lines(awkward)
    assert got.count() == len(AWKWARD) and {r.doc_id: r.n_lines for r in got.collect()}[9] == 4 and got.columns[: len(awkward.columns)] == awkward.columns
    assert line_dedup.dedup_lines(empty).count() == 0


# --- op 8 ---


def test_language_held_out(spark, sf):
    got = language.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    out = got.where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9


def test_kneser_ney_sums_to_one():
    texts = ["der schnelle braune fuchs", "die katze und der hund", "das haus am see"] * 3
    code, _, _ = language.gram_codes(texts)
    model = language.KneserNey(code)
    contexts = np.unique(code >> np.uint64(language.BITS))[:50]
    for c in [*contexts.tolist(), 0x2A5A5]:
        p = model.probabilities((np.uint64(c) << np.uint64(language.BITS)) + np.arange(language.SYMBOLS, dtype=np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney with dictionaries over tuples of characters; -ln p of each character of a text."""
    grams = lambda t: [(" " * 3 + t)[k : k + 4] for k in range(len(t))]
    clean = lambda t: " " + re.sub(r"[^\W\d_]", lambda c: c[0].lower()[0], " ".join(re.findall(r"[^\W\d_]+", t)) + (" " if t and not t[-1].isalpha() else ""))
    counts = [Counter(g for t in texts for g in grams(clean(t)))]
    for n in (3, 2, 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    discounts, totals, kinds = [], [], []
    for c in counts:
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        discounts.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.1)
        totals.append(Counter())
        kinds.append(Counter(g[:-1] for g in c))
        for g, v in c.items():
            totals[-1][g[:-1]] += v

    def p(g, level):
        if level == 4:
            return 1 / 65536
        low, t = p(g[1:], level + 1), totals[level][g[:-1]]
        return (max(counts[level][g] - discounts[level], 0) + discounts[level] * kinds[level][g[:-1]] * low) / t if t else low

    return lambda t: np.array([-np.log(p(g, 0)) for g in grams(clean(t))])


def test_kneser_ney_equals_plain():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdeß я ωñ-3 ") for _ in range(60)) for _ in range(20)] + ["Русский ТЕКСТ, 12 και ελληνικά!", "ภาษาไทย 한국어"]
    rates, model = plain_kneser_ney(texts), language.KneserNey(language.gram_codes(texts)[0])
    for t in ["abc ßя", "x", "ТЕКСТ русский", "zz Ωmega 7", "12 a", *texts[:3]]:
        code, _, _ = language.gram_codes([t])
        assert -np.log(model.probabilities(code)) == pytest.approx(rates(t), rel=1e-4)


def test_scripts_are_told_apart(spark):
    words = {"ru": "это русский язык который нельзя путать", "uk": "це українська мова яку не можна плутати", "bg": "това е български език който не бива да се бърка", "el": "αυτή είναι η ελληνική γλώσσα που δεν πρέπει"}
    rng = random.Random(13)
    text = lambda name: " ".join(rng.choice(words[name].split()) for _ in range(30))
    rows = [(k, text(name), name) for k, name in enumerate(list(words) * 40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [(text(name), name) for name in list(words) * 5]
    got = model.scorer().judge([t for t, _ in new])
    assert [g[0] for g in got] == [name for _, name in new] and not any(g[2] for g in got)
    assert np.isfinite(model.limit) and model.scorer().judge(["中文 文字 沒有 人 知道 怎麼 說 這個 東西 是 什麼"])[0][2]


def test_language_does_not_depend_on_neighbours(spark, sf):
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = ["der hund und", "x", None, "Été là-bas", "12", "the other nation"] * 2
    one = [model.scorer().judge([t])[0] for t in texts[:6]]
    both = model.scorer().judge(texts)
    assert [b[0] for b in both[:6]] == [o[0] for o in one] and np.allclose([b[1] for b in both[6:]], [o[1] for o in one])
    assert both[2][0] == both[4][0] == "und" and both[2][2]
    assert model.scorer().judge(["это русский текст без латинских букв совсем"])[0][2]


def test_language_awkward(awkward, empty):
    model = language.fit(awkward)
    assert language.identify(awkward, model).count() == len(AWKWARD) and language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(awkward, nothing).collect()} == {"und"}


# --- op 9 ---


def test_laws_and_adpcm():
    pcm = (np.sin(np.arange(5000) / 15) * 12000).astype(np.int16)
    for law in (audio.MULAW_PCM, audio.ALAW_PCM):
        assert np.abs(law[audio.encode_law(pcm, law)].astype(int) - pcm).max() <= 512
        assert np.array_equal(law[audio.encode_law(law, law)], law)
    assert (audio.MULAW_PCM[0], audio.MULAW_PCM[0x80], audio.MULAW_PCM[0xFF]) == (-32124, 32124, 0) and (audio.ALAW_PCM[0xD5], audio.ALAW_PCM[0x55]) == (8, -8)
    blocks = audio.ima_encode(pcm)
    assert np.abs(audio.ima_blocks(blocks).ravel()[: len(pcm)].astype(int) - pcm).mean() < 300
    one = np.stack([audio.ima_blocks(b[None])[0] for b in blocks])
    assert np.array_equal(one, audio.ima_blocks(blocks))


def test_feature_does_not_depend_on_stretches(monkeypatch):
    data = bytes(random.Random(16).randrange(256) for _ in range(2000))
    whole = audio._pcm_feature(audio.MULAW, 1, data, audio.RATE)
    pcm = audio.resample(audio.MULAW_PCM[np.frombuffer(data, np.uint8)], 8000, 16000)
    assert whole.startswith(f"pcm:{zlib.crc32(pcm):08x}:rms={(pcm.astype(float) ** 2).mean() ** 0.5:.1f}:peak={np.abs(pcm.astype(int)).max()}:")
    for n in (1, 7, 64, 1999, 2000):
        monkeypatch.setattr(audio, "SAMPLES", n)
        assert audio._pcm_feature(audio.MULAW, 1, data, audio.RATE) == whole


def test_decode_column(spark):
    pcm = (np.sin(np.arange(800) / 9) * 9000).astype(np.int16)
    media = [audio.wav(audio.MULAW, audio.encode_law(pcm, audio.MULAW_PCM).tobytes()), audio.wav(audio.IMA, audio.ima_encode(pcm).tobytes(), block=audio.BLOCK), audio.wav(audio.PCM, pcm.tobytes()), b"no file", None, b""]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(media)], "id int, media binary")
    got = {r.id: r.pcm for r in audio.decode_audio(df, "media").collect()}
    assert got[3] is got[4] is got[5] is None
    for k in range(3):
        kind, rate, _, data = audio.read_wav(bytes(got[k]))
        assert (kind, rate) == (audio.PCM, 16000) and np.abs(np.frombuffer(data, "<i2")[: 2 * len(pcm) : 2].astype(int) - pcm).mean() < 500
    assert len(audio.resample(pcm, 8000, 6000)) == 600


def test_media_round_trip(spark, awkward, empty, tmp_path):
    got = sorted(((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in audio.op9_media_audio(spark, table_folder(tmp_path, awkward)).collect()), key=repr)
    want = []
    for r in AWKWARD:
        b = (r[1] or "").encode()
        p = b + bytes(64 * max(1, -(-len(b) // 64)) - len(b))
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr)
    assert audio.op9_media_audio(spark, table_folder(tmp_path, empty)).count() == 0


# --- op 10 ---


def test_urls(spark):
    urls = {
        1: "https://A.Example.NET/en/x?q#f", 2: "http://example.net/de/", 3: "x://shop.example.com/de/1", 4: "https://sub.org/fr/a", 5: None, 6: "no scheme", 7: "http://net", 8: "http://net/", 9: "a://b://c/d",
        10: "https://cheap-pills.example.com/en/1", 11: "https://blog.theother.example.org/en/2", 12: "http://myexample.net.org/en/",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.default_model()).collect()}
    assert [(got[k].rule, got[k].verdict) for k in (1, 2, 3, 4)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/x") and (got[5].host, got[5].path, got[5].rule) == ("", "", None) and got[6].host == ""
    assert got[7].rule is None and got[8].rule == "net/" and got[9].host == "b:" and got[12].rule is None
    assert (got[10].verdict, got[11].verdict) == ("block", "allow")
    grams = df.where("url is not null").select("url", url_filter.gram_buckets(*url_filter.host_path(F.col("url"))).alias("g")).collect()
    assert all(list(r.g) == url_filter.labelled_grams(r.url) for r in grams)
    assert url_filter.judge_urls(df.where("false"), url_filter.default_model()).count() == 0


def test_odd_urls_have_the_same_grams(spark):
    urls = ["http://x.net", "", "a", "http://a\nb\u0085c\u2028d/\r\ne", "https://\U0001f600\U00010400.org/\U0001f4a9\n", "://", "http://ÄÖ.de/é?x", "h://" + "ab" * 3000, "http://\x00\x01.net/\t"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for _ in range(3):
        got = {r.url: list(r.g) for r in df.select("url", url_filter.gram_buckets(*url_filter.host_path(F.col("url"))).alias("g")).collect()}
        assert got == {u: url_filter.labelled_grams(u) for u in urls}


def test_url_model_held_out(spark):
    model, rows = url_filter.fit(url_filter.labelled_urls(False)), url_filter.labelled_urls(True)
    df = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    got = [(r.y, r.verdict == "block") for r in url_filter.judge_urls(df, model, rules=()).collect()]
    right, blocked, bad = sum(y and b for y, b in got), sum(b for _, b in got), sum(y for y, _ in got)
    assert right >= 0.95 * blocked and right >= 0.8 * bad > 20
    plain = [None, "", "http://x.net", "https://github.com/apache/spark", "https://wikipedia.org/wiki/Berlin", "https://berlin.de/rathaus", "https://arxiv.org/abs/1"]
    df = spark.createDataFrame(list(enumerate(plain)), "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(df, url_filter.default_model(), rules=()).collect()} == {"allow"}


# --- queries ---

COLUMNS = {
    "op1_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_private_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_equal_plain(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == COLUMNS[name]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = df.toPandas()
    if name.startswith("op1"):
        assert sorted(got.itertuples(index=False, name=None)) == sorted(brute_components(docs.items()))
    elif name.startswith("op4"):
        assert len(got) == len(docs)
        for r in got.itertuples():
            base = sorted(plain_spans(docs[r.doc_id]), key=lambda s: (private.KINDS.index(s[0]), s[1]))
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert hashlib.sha256(text.encode()).hexdigest() == r.base_sha256 and set(filter(None, text.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in private.KINDS]
            every = [(private.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in r.spans.split(",") if x)]
            assert every == sorted(every)
    else:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(packing.vocabulary_path())
        want = Counter()
        for i, t in docs.items():
            ids = [*plain.encode(t, add_special_tokens=False).ids, packing.END]
            for s in range(0, len(ids), packing.CAPACITY):
                part = ids[s : s + packing.CAPACITY]
                want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
        assert Counter(got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.length.sum() <= packing.CAPACITY and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()


# --- pipeline ---


def test_pipeline_equals_plain_steps(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, sf).persist()
    assert kept.columns == docs.columns and kept.count() > 0.95 * docs.count()
    lines = corpus_pipeline.dedup_lines(spark, kept, sf).persist()
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted(x[:2] for x in plain_dedup([(r.doc_id, r.text) for r in kept.collect()]))
    assert not lines.where("n_chars <> char_length(text)").count()
    near = corpus_pipeline.dedup_near(spark, lines, sf).persist()
    plain = brute_components([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, _, c in plain if i == c}
    mixed = corpus_pipeline.mix_sources(spark, near, sf).persist()
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf).toPandas()
    assert packed.length.sum() == sum(len(x) for x in packing.token_ids([r.text for r in mixed.collect()], packing.vocabulary_path()))


def test_pipeline_awkward(spark, awkward, empty, tmp_path):
    import corpus_pipeline

    for df in (awkward, empty):
        folder = table_folder(tmp_path, df)
        corpus_pipeline.run(spark, folder).count()
    clash = awkward.withColumns({"score": F.lit(7), "n_lines": F.lit(8), "id_": F.lit(9)})
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.dedup_lines):
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and {(r.score, r.n_lines, r.id_) for r in out.collect()} == {(7, 8, 9)}
    twice = corpus_pipeline.dedup_near(spark, awkward, "")
    assert Counter(r.doc_id for r in twice.collect())[5] == 1


def test_near_keeps_clean_rows_of_one_id(spark):
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (None, ""), (None, None)]  # b is near to b
    rows += [(1, text("d")), (1, text("e")), (9, text("e") + " more"), (1, text("f")), (1, text("f")), (8, text("a"))]  # one id on three texts
    rows += [(2, "  "), (2, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_", F.lit("own"))
    for parts in (1, 3):
        got = corpus_pipeline.dedup_near(spark, docs.repartition(parts), "")
        assert got.columns == docs.columns
        want = [(None, text("b")), (None, text("c")), (None, ""), (None, None), (1, text("d")), (1, text("e")), (1, text("f")), (8, text("a")), (2, "  "), (2, "  ")]
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
