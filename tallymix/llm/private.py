"""Personal data: patterns, and a character BiLSTM with CRF transitions for what the patterns miss.

The base patterns find email, ip, card and phone.  The tagger is written and
trained in numpy from labelled spans.  It reads windows of ``WINDOW`` characters
that start every ``STEP``; each is decoded by Viterbi.  The windows are
reconciled over the whole text: each character takes its tag from the window in
whose middle it is, so a span may be of any length, and spans are what the tags
of the whole text say.  The surest come first, none over another or over a base
span.  A span is added if it is whole by the rules of its kind (an address's two
sides, four parts up to 255, a valid check digit, enough digits); the rules
don't move its ends, but for marks and spaces there.

The decoder's emissions are masked: numbers' tags are allowed in stretches of
digits and what stands between them, email tags in stretches of address
characters around an at-sign or a written one, "(at)"; see ``allowed_tags``.
Where nothing is allowed the only path is outside, so windows without an allowed
place are not run; this follows from the mask and loses nothing.

Labelled spans come from ``labelled_texts``: invented sentences with personal
data written in many ways, and with numbers, hashes, dates and versions that are
none.  Other labelled spans can be given to ``Tagger.fit``.

Edge cases: null text is empty and has no span; texts of any length are read
whole; repeated rows get equal spans; other columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, slices, table

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)
WINDOW, STEP = 96, 48
HIDDEN, CLASSES = 20, 64
EXAMPLES, EPOCHS, BATCH, RATE = 3600, 8, 96, 1.2e-2
RUN = 1024
LEAST_SCORE = 0.5
#: Emission of a tag that isn't allowed.
MASKED = -1e6

# --- base patterns ---------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small_number(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern's spans, by kind and then start; each pattern is walked from mark to mark, in linear time."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    k = 0
    while k + 3 < len(runs):
        if all(runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] == "." for j in range(k, k + 3)):
            if all(small_number(text[s:e]) for s, e in runs[k : k + 4]):
                out.append(("ip", runs[k][0], runs[k + 3][1]))
            k += 4
        else:
            k += 1
    k = 0
    while k < len(runs):
        j = k
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
        digits = sum(e - s for s, e in runs[k : j + 1])
        if 16 <= digits <= 19 and luhn("".join(text[s:e] for s, e in runs[k : j + 1])):
            out.append(("card", runs[k][0], runs[j][1]))
        k = j + 1
    at = text.find("+") if runs else -1
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# --- labelled spans --------------------------------------------------------------------------


def labelled_texts(n: int = EXAMPLES, seed: int = 17) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented texts of about one window with their spans."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(("an", "the", "or", "ti", "on", "er", "le", "sch", "é", "ei", "ment", "de", "ñ", "ou", "st", "a")) for _ in range(int(rng.integers(1, 5))))
    name = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(3, 9))))

    def card() -> str:
        d = digits(pick((15, 15, 16, 17, 18)) - 0)
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        s = pick(("", "", " ", "-", "."))
        return s.join(d[k : k + 4] for k in range(0, len(d), 4))

    def email() -> str:
        user = pick((name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}_{digits(3)}", f"{name()}+{name()}"))
        at, dot = pick((("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", ".")))
        return user + at + dot.join([name(), *([name()] * int(rng.integers(0, 2))), pick(("com", "org", "net", "de", "es", "fr"))])

    def ip() -> str:
        return pick((".", ".", ".", "[.]", " . ")).join(str(rng.integers(0, 256)) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(1)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{digits(2)} {c}", f"0{digits(2)}/{b} {c}"))

    def none() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(8, 41))))
        return pick((digits(int(rng.integers(1, 7))), digits(int(rng.integers(7, 13))), f'"{hexes}"', hexes, f"{digits(1)}.{digits(1)}.{digits(2)}", f"{rng.integers(1900, 2100)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}", f"{digits(3)},{digits(3)}", f"@{name()}", f"{name()} (at) {pick(('noon', 'home', 'last'))}", f"{digits(2)}%", f"{digits(4)} {digits(2)}"))

    makers, out = {"email": email, "ip": ip, "card": card, "phone": phone}, []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            draw = rng.random()
            if draw < 0.14:
                kind = pick((*KINDS, "phone", "card"))
                what = makers[kind]()
                spans.append((kind, len(text), len(text) + len(what)))
            else:
                what = none() if draw < 0.22 else word() + pick(("", "", "", ",", ".", "!!", "%%%"))
            text += what + pick((" ", " ", " ", " ", "\n", " | "))
        out.append((text, spans))
    return out


# --- tagger ----------------------------------------------------------------------------------


@functools.cache
def _class_table() -> np.ndarray:
    """ASCII by character (upper case as lower), then other letters, then the rest; 0 pads."""
    out = np.full(0x250, 62, np.uint8)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789@.+-_%()[] \n/:,|\"'!?#&*="):
        out[ord(c)] = 1 + k if 1 + k < 61 else 61
        out[ord(c.upper())] = out[ord(c)]
    out[0x80:] = 63
    return out


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _class_table()[np.minimum(points, 0x24F)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Both directions' LSTMs over character classes, a linear layer to tags, and a CRF's transitions and starts."""

    def __init__(self, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"out": draw(2 * h, TAGS), "out_b": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(CLASSES, 4 * h), f"h{d}": draw(h, 4 * h)}
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # forget gates start open

    def _lstm(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN) of one direction; gates are input, forget, output, cell."""
        n, steps = codes.shape
        h, wx, wh = HIDDEN, self.p[f"x{d}"], self.p[f"h{d}"]
        out, state, cell = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[codes[:, t]] + state @ wh
            g, u = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, hidden = cell, state
            cell = g[:, h : 2 * h] * cell + g[:, :h] * u
            squashed = np.tanh(cell)
            state = g[:, 2 * h :] * squashed
            out[t] = state
            if keep is not None:
                keep.append((t, g, u, before, squashed, hidden))
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(time, batch, TAGS)"""
        return np.concatenate([self._lstm(codes, "f"), self._lstm(codes, "b")], 2) @ self.p["out"] + self.p["out_b"]

    def decode(self, codes: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best path (batch, time) of the allowed tags (batch, time, TAGS), all if not given, and, at each place, how far its tag's emission is above that of outside."""
        e = self.emissions(codes)
        if allowed is not None:
            e = np.where(allowed.transpose(1, 0, 2), e, np.float32(MASKED))
        steps, n, _ = e.shape
        back, score = np.empty((steps, n, TAGS), np.int8), self.p["first"] + e[0]
        for t in range(1, steps):
            s = score[:, :, None] + self.p["moves"]
            back[t] = s.argmax(1)
            score = s.max(1) + e[t]
        path = np.empty((n, steps), np.int8)
        path[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        e = e.transpose(1, 0, 2)
        return path, np.take_along_axis(e, path[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients by forward-backward and through time."""
        n, steps = codes.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._lstm(codes, d, kept[d]) for d in "fb"], 2)
        e = states @ self.p["out"] + self.p["out_b"]
        moves, first = self.p["moves"], self.p["first"]
        fold = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, steps):
            alpha[t] = fold(alpha[t - 1][:, :, None] + moves, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = fold(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = fold(alpha[-1], 1)
        here = np.exp(alpha + beta - total[None, :, None])
        pairs = np.exp(alpha[:-1, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        gold, at = tags.T, np.arange(n)
        value = first[gold[0]].sum() + e[np.arange(steps)[:, None], at, gold].sum() + moves[gold[:-1], gold[1:]].sum()
        true_pairs = np.zeros((TAGS, TAGS))
        np.add.at(true_pairs, (gold[:-1], gold[1:]), 1)
        de = here.copy()
        de[np.arange(steps)[:, None], at, gold] -= 1
        de = (de / n).astype(np.float32)
        start = here[0].sum(0) - np.bincount(gold[0], minlength=TAGS)
        g = {"moves": ((pairs - true_pairs) / n).astype(np.float32), "first": (start / n).astype(np.float32), "out": states.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "out_b": de.sum((0, 1))}
        ds, h = de @ self.p["out"].T, HIDDEN
        for k, d in enumerate("fb"):
            wh = self.p[f"h{d}"]
            gx, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, gate, u, before, squashed, hidden in reversed(kept[d]):
                dh = dh + ds[t, :, k * h : (k + 1) * h]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - u**2)], 1)
                np.add.at(gx, codes[:, t], dz)
                gh += hidden.T @ dz
                dh, dc = dz @ wh.T, dc * f
            g[f"x{d}"], g[f"h{d}"] = gx, gh
        return float((total.sum() - value) / n), g

    def fit(self, texts: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = 4) -> Tagger:
        """Adam over windows of the labelled texts."""
        codes, tags = windows_of(texts)
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(codes), BATCH):
                i = order[k : k + BATCH]
                _, g = self.gradients(codes[i], tags[i])
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                step += 1
                rate = RATE * (1 - epoch / epochs) ** 0.5
                for name, d in g.items():
                    d = d * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d**2
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows_of(texts: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each labelled text and, where it is longer, those that follow by STEP."""
    codes, tags = [], []
    for text, spans in texts:
        c, t = char_classes(text), np.zeros(len(text), np.int8)
        for kind, a, b in spans:
            t[a:b] = 1 + KINDS.index(kind)
        for at in range(0, max(1, len(c) - STEP), STEP):
            part = slice(at, at + WINDOW)
            codes.append(np.pad(c[part], (0, WINDOW - len(c[part]))))
            tags.append(np.pad(t[part], (0, WINDOW - len(t[part]))))
    return np.array(codes), np.array(tags).astype(np.int64)


@functools.cache
def default_tagger() -> Tagger:
    return Tagger().fit(labelled_texts())


# --- spans of whole texts --------------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)"
_DOT = r"(?:\s?\.\s?|\s?[(\[]\s?dot\s?[)\]]\s?)"
_MARK = re.compile(_AT, re.IGNORECASE)
_RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.IGNORECASE)
_NUMBERS = re.compile(r"[0-9 .()\[\]/+-]+")
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_SPOKEN_IP = re.compile(r"[0-9]+(?:\s?(?:\[\.\]|\.)\s?[0-9]+){3}")
_NUMBER = re.compile(r"[0-9+(][0-9 ()./+-]*[0-9]")
#: Least digits of a stretch where numbers' tags are allowed: those of an ip.
LEAST_DIGITS = 4
_TRIM = " \t\r\n.,;:!?\"'|"


def allowed_stretches(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether of numbers) of the stretches where tags other than outside are allowed, in linear time."""
    out = []
    for m in _NUMBERS.finditer(text):
        if sum("0" <= c <= "9" for c in m[0]) >= LEAST_DIGITS:
            out.append((*m.span(), True))
    end = 0
    for m in _MARK.finditer(text) if "@" in text or "at" in text or "AT" in text or "At" in text or "aT" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        right = _RIGHT.match(text, m.end())
        if right and start < m.start():
            out.append((start, right.end(), False))
        end = m.end()
    return out


def valid_span(kind: str, text: str) -> bool:
    """Whether a tagged stretch is whole by the rules of its kind."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return _ADDRESS.fullmatch(text) is not None
    if kind == "ip":
        return _SPOKEN_IP.fullmatch(text) is not None and all(small_number(x) for x in re.findall("[0-9]+", text))
    if kind == "card":
        return _NUMBER.fullmatch(text) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return _NUMBER.fullmatch(text) is not None and 9 <= len(digits) - 2 * text.startswith("00") <= 15


def middle(k: int, last: int, length: int) -> tuple[int, int]:
    """The characters that take their tags from window k of 0 .. last in a text of this length."""
    margin = (WINDOW - STEP) // 2
    return (0 if k == 0 else k * STEP + margin), (length if k == last else (k + 1) * STEP + margin)


def reconciled(text: str, tagged: list[tuple[float, str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the whole text's tagged stretches (score, kind, start, end) those to add, the surest first; none over another or over ``taken``."""
    busy, out = [(a, b) for _, a, b in taken], []
    for _, kind, a, b in sorted(tagged, key=lambda x: (-x[0], x[2], x[3], x[1])):
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip(_TRIM)), b - (len(part) - len(part.rstrip(_TRIM)))
        if a < b and valid_span(kind, text[a:b]) and all(b <= x or a >= y for x, y in busy):
            busy.append((a, b))
            out.append((kind, a, b))
    return out


def added_spans(texts: list[str], taken: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """The spans that the tagger adds to each text."""
    stretches = [allowed_stretches(t) for t in texts]
    places: list[tuple[int, int, int]] = []
    for t, (text, found) in enumerate(zip(texts, stretches, strict=True)):
        last, margin = max(0, -(-(len(text) - WINDOW) // STEP)), (WINDOW - STEP) // 2
        of = lambda p: min(last, max(0, (p - margin) // STEP))  # noqa: B023, E731
        places += [(t, k, last) for k in sorted({k for a, b, _ in found for k in range(of(a), of(b - 1) + 1)})]
    # by text, (place, tag, how far above outside) of the tagged characters
    hits: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for i in range(0, len(places), RUN):
        part = places[i : i + RUN]
        codes, allowed = np.zeros((len(part), WINDOW), np.uint8), np.zeros((len(part), WINDOW, TAGS), bool)
        allowed[:, :, 0] = True
        for row, mask, (t, k, _) in zip(codes, allowed, part, strict=True):
            s = k * STEP
            c = char_classes(texts[t][s : s + WINDOW])
            row[: len(c)] = c
            for a, b, numbers in stretches[t]:
                if a < s + WINDOW and b > s:
                    mask[max(0, a - s) : b - s, 2 if numbers else 1 : None if numbers else 2] = True
        path, above = tagger.decode(codes, allowed)
        for tags, over, (t, k, last) in zip(path, above, part, strict=True):
            a, b = middle(k, last, len(texts[t]))
            at = a - k * STEP + np.flatnonzero(tags[a - k * STEP : b - k * STEP])
            hits[t] += zip((at + k * STEP).tolist(), tags[at].tolist(), over[at].tolist(), strict=True)
    return [reconciled(text, _runs(got), base) if got else [] for text, got, base in zip(texts, hits, taken, strict=True)]


def _runs(hits: list[tuple[int, int, float]]) -> list[tuple[float, str, int, int]]:
    """Stretches of one tag (score, kind, start, end) of a text's tagged characters, in order of place."""
    at, tag, over = (np.array(x) for x in zip(*hits, strict=True))
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(tag) != 0)) + 1, [len(at)]])
    out = [(float(over[x:y].mean()), KINDS[tag[x] - 1], int(at[x]), int(at[y - 1]) + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x for x in out if x[0] >= LEAST_SCORE]


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_private(df: DataFrame, tagger: Tagger | None = None, column: str = "text") -> DataFrame:
    """Adds ``spans`` (kind, start, end in code points, whether by pattern) and ``redacted``; columns of these names are replaced."""
    rest = df.drop("spans", "redacted")
    sent = Sent(df.sparkSession, tagger or default_tagger())
    schema = rest.withColumns({"spans": F.lit(None).cast(SPAN), "redacted": F.lit("")}).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, column)):
            texts = [t or "" for t in b.column(column).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, sent.value)
            rows = [[{"kind": k, "start": s, "end": e, "base": own} for own, x in ((True, x), (False, y)) for k, s, e in x] for x, y in zip(base, more, strict=True)]
            clean = [redacted(t, x + y) if x or y else t for t, x, y in zip(texts, base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(clean, pa.string())], schema.names)

    return rest.mapInArrow(run, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    for b in batches:
        base, every = [], []
        for row in b.column("spans").to_pylist():
            spans = [(s["kind"], s["start"], s["end"]) for s in row]
            base.append([s for s, r in zip(spans, row, strict=True) if r["base"]])
            every.append(spans)
        counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([joined(x) for x in every], pa.string())], names)


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text"))
    return found.select("doc_id", "spans").mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
