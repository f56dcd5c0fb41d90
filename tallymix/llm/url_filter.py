"""URL filters: host and path rules first, a logistic regression on hashed character n-grams for the rest.

Everything that touches the table of urls is a Column expression.  The model is
fitted on the driver from a small labelled url table, and is put into the plan as an array of ``BUCKETS``
weights: its size is fixed.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict of the model's intercept.  Repeated rows are judged each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

BUCKETS = 8192
GRAM = 3
#: (host/path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words of hosts that advertise, gamble, sell or deceive, words that go with them, and words and hosts of other sites.
_BAD = ("casino", "poker", "jackpot", "slots", "roulette", "betting", "gamble", "lottery", "viagra", "cialis", "pills", "pharma", "steroids", "porn", "xxx", "escorts", "webcams", "nude", "payday", "loans", "forex", "replica", "rolex", "warez", "keygen", "torrent", "malware", "phishing", "spam", "clickbait", "adserver", "popunder", "tracker", "prizes", "winner", "bonus", "freebies", "meds", "bets", "adclick", "ads", "tracking")
_PUSH = ("cheap", "free", "best", "win", "online", "hot", "easy", "instant", "top", "deals", "shop", "big", "now", "club", "farm", "click")
_GOOD = ("library", "weather", "garden", "university", "museum", "news", "physics", "recipes", "history", "council", "research", "school", "railway", "gazette", "archive", "orchestra", "hospital", "church", "theatre", "football", "cycling", "travel", "maps", "music", "books", "science", "nature", "energy", "bakery", "kitchen", "forum", "wiki", "docs", "photos", "family", "village", "harbour", "forest", "river", "mountain", "insurance", "law", "medicine", "biology", "chemistry", "economics", "politics", "poetry", "painting", "software", "compiler", "database", "engine", "institute", "journal", "report", "parliament", "ministry", "observatory", "workshop")
_SITES = ("mozilla.org", "debian.org", "kernel.org", "python.org", "stackoverflow.com", "gitlab.com", "bbc.co.uk", "nytimes.com", "theguardian.com", "lemonde.fr", "elpais.com", "spiegel.de", "nasa.gov", "cern.ch", "who.int", "unesco.org", "europa.eu", "mit.edu", "ox.ac.uk", "ethz.ch", "openstreetmap.org", "gutenberg.org", "imdb.com", "nature.com", "paris.fr", "madrid.es", "hamburg.de", "london.gov.uk", "rfc-editor.org", "sqlite.org")
_ONSETS, _VOWELS = ("b", "br", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "tr", "v", "w", "z"), ("a", "e", "i", "o", "u", "ei", "ou")


def _invented(k: int) -> str:
    """A pronounceable name without meaning: two or three syllables."""
    out, k = "", k * 2654435761 % (1 << 32)
    for _ in range(2 + k % 2):
        k, onset = divmod(k, len(_ONSETS))
        k, vowel = divmod(k, len(_VOWELS))
        out += _ONSETS[onset] + _VOWELS[vowel] + ("", "n", "r", "l")[k % 4]
    return out


def labelled_urls(held_out: bool | None = None) -> list[tuple[str, int]]:
    """A small table of urls by rule; 1: to be blocked.  Subdomains, top domains and page names say nothing about the label.

    Every fifth host is held out: ``False`` gives the rest, ``True`` only these.
    A host is held out whole, its words are not.
    """
    names = [(f"{x}{('-', '')[(j + k) % 2]}{y}", 1) for k, b in enumerate(_BAD) for j in range(4) for x, y in [((_PUSH[(5 * k + j) % len(_PUSH)], b) if j % 2 else (b, _PUSH[(3 * k + j) % len(_PUSH)]))]]
    names += [(f"{x}-{_BAD[(k + 7) % len(_BAD)]}", 1) for k, x in enumerate(_BAD)]
    names += [(x, 0) for x in _GOOD] + [(f"{x}{('-', '')[k % 2]}{_GOOD[(k + 11) % len(_GOOD)]}", 0) for k, x in enumerate(_GOOD)]
    names += [(_invented(k), 0) for k in range(1, 260)] + [(f"{_invented(k)}-{_GOOD[k % len(_GOOD)]}", 0) for k in range(300, 400)]
    out: list[tuple[str, int]] = []
    for k, (name, label) in enumerate(names):
        if held_out is None or (k % 5 == 4) == held_out:
            n = k * 7919 % 60_000
            tail = f"/{('en', 'de', 'fr', 'es', 'a', 'item')[k % 6]}/{n}{('', '.html', '?page=2', '#top', '/')[n % 5]}"
            sub, top = ("www.", "blog.", "", "m.", "")[k % 7 % 5], ("com", "org", "net", "info", "de", "example.com", "example.org")[k % 7]
            out.append((f"https://{sub}{name}.{top}{tail}", label))
            if k % 3 == 0:
                out.append((f"https://{sub}example.{top}/{name}{tail}", label))
    out += [(f"https://{host}/{('', 'about', 'en/help', 'index.html')[k % 4]}", 0) for k, host in enumerate(_SITES) if held_out is None or (k % 5 == 4) == held_out]
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; path: from there to ``? #`` or the end."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def gram_buckets(host: Column, path: Column) -> Column:
    """The bucket of each character 3-gram of ``^host$`` and of the path after a mark."""
    text = F.concat(F.lit("^"), host, F.lit("$"), lower_ascii(path))
    # split() by nothing gives code points in one walk; substring() from each place would walk the text again
    chars = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    n = F.size(chars)
    return F.when(n >= GRAM, F.zip_with(F.slice(chars, 1, F.greatest(n - 2, F.lit(0))), F.zip_with(F.slice(chars, 2, F.greatest(n - 2, F.lit(0))), F.slice(chars, 3, F.greatest(n - 2, F.lit(0))), lambda b, c: b * 31 + c), lambda a, bc: F.pmod(a * 961 + bc, F.lit(BUCKETS)))).otherwise(F.array().cast("array<bigint>"))


def labelled_grams(url: str) -> list[int]:
    """``gram_buckets`` of one labelled url, for fitting on the driver; a test holds the two together."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = m.groups() if m else ("", "")
    codes = [ord(c) for c in re.sub("[A-Z]", lambda c: c[0].lower(), f"^{host}${path}")]
    return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:])]


def fit(rows: Sequence[tuple[str, int]] | None = None, epochs: int = 600, rate: float = 8.0, decay: float = 2e-5, lean: float = -1.0) -> tuple[float, list[float]]:
    """Full-batch gradient descent on scaled n-gram counts; (intercept, weights).  The labelled table is small by contract and lives on the driver.

    The intercept is drawn towards ``lean``: a url that says nothing is allowed.
    """
    rows = labelled_urls() if rows is None else list(rows)
    if not rows:
        return 0.0, [0.0] * BUCKETS
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[1] for r in rows], float)
    for k, (url, _) in enumerate(rows):
        g = labelled_grams(url)
        np.add.at(x[k], g, 1.0 / math.sqrt(max(1, len(g))))
    used = np.flatnonzero(x.any(0))
    x, bias, w = x[:, used], lean, np.zeros(len(used))
    for _ in range(epochs):
        e = 1.0 / (1.0 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        bias -= e.mean() + 0.5 * (bias - lean)
        w -= rate * (x.T @ e / len(y) + decay * w)
    out = np.zeros(BUCKETS)
    out[used] = w
    return round(float(bias), 6), [round(float(v), 6) for v in out]


@functools.cache
def default_model() -> tuple[float, list[float]]:
    return fit()


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; among rules of one length the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, (text, says) in sorted(enumerate(rules), key=lambda r: (len(r[1][0]), -r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(df: DataFrame, model: tuple[float, list[float]], rules: Sequence[tuple[str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score (the model's probability of block) and verdict to each row; columns of these names are replaced."""
    bias, weights = model
    host, path = host_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    table_of_weights = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    grams = gram_buckets(F.col("host"), F.col("path"))
    z = F.aggregate(grams, F.lit(0.0).cast("double"), lambda s, b: s + F.element_at(table_of_weights, (b + 1).cast("int"))) / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "score": 1.0 / (1.0 + F.exp(-(z + F.lit(float(bias)))))})
    return df.withColumn("verdict", F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, default_model()).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql(model: tuple[float, list[float]]) -> str:
    """The same in DuckDB, with the model's weights as constants."""
    bias, weights = model
    return f"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
w AS (SELECT [{", ".join(f"{w!r}" for w in weights)}]::DOUBLE[] AS ws),
t AS (SELECT *, '^' || host || '$' || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM u),
g AS (
  SELECT *, list_transform(range(1, greatest(length(x) - 1, 1)),
    lambda i: (unicode(substr(x, i, 1)) * 961 + unicode(substr(x, i + 1, 1)) * 31 + unicode(substr(x, i + 2, 1))) % {BUCKETS}) AS grams
  FROM t),
s AS (
  SELECT page_id, host, path,
         coalesce(list_sum(list_transform(grams, lambda b: ws[b + 1])), 0) / sqrt(greatest(len(grams), 1)) + ({bias!r}) AS z
  FROM g, w),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN z >= 0 THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
