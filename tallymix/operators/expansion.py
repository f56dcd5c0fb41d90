"""Sums over all rows q of one factor, at each row z of another: of v / (1 + qz) and of v ln(1 + qz), neither by pairs.

Rows go into boxes by the logarithms of q_k + 1 / (K top_k), where ``top`` bounds
the places z.  With a box's middle p, its rows p + e and D = 1 + pz,

    1 / (1 + qz) = 1 / D sum_j (-ez / D)^j,     |ez / D| <= max_k |e_k| / (p_k + 1 / (K top_k)) = reach < 1,

so the box is known by the sums of v and e's monomials up to the degree at which
reach to that power is below ``DIGITS``, and costs their number at each place,
whatever number of rows it has.  A box with fewer rows than that keeps its rows.
The logarithm has the same monomials.  What is left out is below ``DIGITS`` of
each term, which is what the addition of the terms one by one loses as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of a term that may be left out, and the finest boxes' width in ln q; coarser ones are 2, 4, ... of them wide.
DIGITS, FINEST, COARSER = 1e-14, 0.125, 5
#: Boxes that may meet on the driver, monomials of one, and bytes of rows that no box holds.
MOST_BOXES, MOST_TERMS, SPARE_BYTES = 1 << 15, 1 << 13, 256 << 20
#: Numbers in one array.
NUMBERS = 1 << 17


def degree(reach: float) -> int:
    """The last power of ``reach`` that counts."""
    return 0 if reach <= DIGITS else ceil(log(DIGITS) / log(reach)) - 1 if reach < 0.7 else 1 << 20


class Monomials:
    """All monomials of some variables up to a degree, by degree; each is an earlier one times a variable."""

    def __init__(self, variables: int, most: int):
        level, self.levels, self.powers = [(0,) * variables], [], [np.zeros((1, variables), int)]
        place = {level[0]: 0}
        for _ in range(most):
            start, of, by = len(place), [], []
            new = []
            for a in level:
                # only variables from the last one used on, so each monomial is made once
                for k in range(max((j for j in range(variables) if a[j]), default=0), variables):
                    b = (*a[:k], a[k] + 1, *a[k + 1 :])
                    place[b] = len(place)
                    new.append(b)
                    of.append(place[a])
                    by.append(k)
            self.levels.append((start, np.array(of), np.array(by)))
            self.powers.append(np.array(new).reshape(-1, variables))
            level = new
        powers = np.concatenate(self.powers)
        self.count, self.total = len(powers), powers.sum(1)
        #: In how many orders the factors of each can be written.
        self.orders = np.array([factorial(int(a.sum())) // np.prod([factorial(int(x)) for x in a], dtype=object) for a in powers], float)

    def at(self, x: np.ndarray) -> np.ndarray:
        """(monomials, places) at places (variables, places)."""
        out = np.empty((self.count, x.shape[1]))
        out[0] = 1
        for start, of, by in self.levels:
            np.multiply(out[of], x[by], out=out[start : start + len(of)])
        return out


class Box:
    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray):
        self.middle = (low + high) / 2
        self.scale = self.middle + floor
        self.degree = degree(float(((high - low) / 2 / self.scale).max()))
        self.sums: np.ndarray | None = None


class Sums:
    """What a task needs for the sums at any places up to ``top``."""

    def __init__(self, top: np.ndarray, boxes: list[Box], q: np.ndarray, v: np.ndarray):
        self.top, self.boxes, self.q, self.v = top, boxes, q, v
        self.tables: dict[int, Monomials] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}

    def table(self, most: int) -> Monomials:
        if most not in self.tables:
            self.tables[most] = Monomials(len(self.top), most)
        return self.tables[most]

    def reciprocals(self, z: np.ndarray) -> np.ndarray:
        return self._at(z, lambda d: 1 / d, lambda j: (-1.0) ** j, False)

    def logarithms(self, z: np.ndarray) -> np.ndarray:
        return self._at(z, np.log, lambda j: np.where(j > 0, -((-1.0) ** j) / np.maximum(j, 1), 0.0), True)

    def _at(self, z: np.ndarray, term, factor, logs: bool) -> np.ndarray:
        places, back = np.unique(z, axis=0, return_inverse=True)
        out = np.zeros((len(places), self.v.shape[1]))
        for box in self.boxes:
            table = self.table(box.degree)
            sums, step = box.sums * table.orders * factor(table.total), max(16, NUMBERS // table.count)
            for a in range(0, len(places), step):
                y = places[a : a + step]
                d = 1 + y @ box.middle
                found = (sums @ table.at((y * box.scale / d[:, None]).T)).T
                out[a : a + step] += found + np.log(d)[:, None] * box.sums[:, 0] if logs else found / d[:, None]
        for a in range(0, len(places) if len(self.q) else 0, 64):
            for b in range(0, len(self.q), NUMBERS // 64):
                d = places[a : a + 64] @ self.q[b : b + NUMBERS // 64].T
                d += 1
                out[a : a + 64] += term(d) @ self.v[b : b + NUMBERS // 64]
        return out[back.reshape(-1)]


def _keys(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
    return np.floor(np.log(q + floor) / FINEST).astype(np.int64)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name).flatten()).astype(float).reshape(b.num_rows, -1)


def _counted(rows: DataFrame, floor: np.ndarray) -> list:
    """(key, n, low, high) of the finest boxes, one more than ``MOST_BOXES`` at most."""
    k = len(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b, "q")
            yield pa.RecordBatch.from_arrays([pa.array(list(_keys(q, floor)), pa.list_(pa.int64())), b.column("q")], ["key", "q"])

    ends = [f(F.get("q", F.lit(j))).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(k)]
    found = rows.select("q").mapInArrow(run, "key array<long>, q array<double>").groupBy("key").agg(F.count("*").alias("n"), *ends)
    return found.limit(MOST_BOXES + 1).collect()


def _merged(found: list, k: int, shift: int) -> dict[tuple, list]:
    """Boxes 2 ** shift times as wide: key -> [n, low, high]."""
    out: dict[tuple, list] = {}
    for r in found:
        low, high = np.array([r[f"low{j}"] for j in range(k)]), np.array([r[f"high{j}"] for j in range(k)])
        key = tuple(x >> shift for x in r.key)
        if key in out:
            held = out[key]
            out[key] = [held[0] + r.n, np.minimum(held[1], low), np.maximum(held[2], high)]
        else:
            out[key] = [r.n, low, high]
    return out


def _chosen(found: list, floor: np.ndarray) -> tuple[int, dict[tuple, Box]]:
    """The width of boxes at which a place costs least, and those that are worth their monomials."""
    k, best = len(floor), (float("inf"), 0, {})
    for shift in range(COARSER if len(found) <= MOST_BOXES else 0):
        cost, boxes = 0, {}
        for key, (n, low, high) in _merged(found, k, shift).items():
            box = Box(low, high, floor)
            terms = comb(box.degree + k, k) if box.degree < 1 << 10 else MOST_TERMS + 1
            if terms <= min(n, MOST_TERMS):
                boxes[key] = box
            cost += min(n, terms) if terms <= MOST_TERMS else n
        best = min(best, (cost, shift, boxes), key=lambda x: x[:2])
    return best[1], best[2]


def sums_over(rows: DataFrame, top: np.ndarray) -> Sums:
    """The sums over stored rows (q, v) of two arrays each, all q at least 0, for places z from 0 to ``top``."""
    top = np.clip(np.asarray(top, float), 1e-150, 1e150)
    first = rows.select(F.size("v").alias("n")).first()
    k, width = len(top), first.n if first else 1
    floor = 1 / (k * top)
    shift, boxes = _chosen(_counted(rows, floor), floor)
    names = {key: j for j, key in enumerate(boxes)}
    made = list(boxes.values())

    def places(q: np.ndarray) -> np.ndarray:
        """Each row's box, or -1."""
        keys, back = np.unique(_keys(q, floor) >> shift, axis=0, return_inverse=True)
        return np.array([names.get(tuple(map(int, key)), -1) for key in keys], int)[back.reshape(-1)]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Monomials] = {}
        held: dict[int, np.ndarray] = {}
        for b in batches:
            q, v = _matrix(b, "q"), _matrix(b, "v")
            at = places(q)
            for j in np.unique(at[at >= 0]):
                box, own = made[j], np.flatnonzero(at == j)
                if box.degree not in tables:
                    tables[box.degree] = Monomials(k, box.degree)
                table = tables[box.degree]
                step = max(16, NUMBERS // table.count)
                for a in range(0, len(own), step):
                    i = own[a : a + step]
                    new = (table.at(((q[i] - box.middle) / box.scale).T) @ v[i]).T
                    held[int(j)] = held[int(j)] + new if int(j) in held else new
        for j, sums in held.items():
            n = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, j)), pa.array(np.arange(n)), pa.array(list(sums.T), pa.list_(pa.float64()))], ["box", "term", "s"])

    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(places(_matrix(b, "q")) < 0))

    if made:
        summed = rows.mapInArrow(added, "box long, term long, s array<double>").groupBy("box", "term").agg(*(F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(width)))
        for box in made:
            box.sums = np.zeros((width, comb(box.degree + k, k)))
        for r in summed.collect():  # fewer rows than monomials of all boxes
            made[r.box].sums[:, r.term] = [r[f"s{j}"] for j in range(width)]
    rest = rows.mapInArrow(spare, "q array<double>, v array<double>") if made else rows.select("q", "v")
    if rest.count() * 8 * (k + width) > SPARE_BYTES:
        raise ValueError("rows of a factor that are like no others are beyond SPARE_BYTES: they have to be in memory")
    t = rest.toArrow()
    q, v = (np.asarray(t.column(c).combine_chunks().flatten()).astype(float).reshape(len(t), -1) if len(t) else np.zeros((0, n)) for c, n in (("q", k), ("v", width)))
    return Sums(top, made, q, v)
