"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised where they are read; only pieces' numbers travel.  A
document longer than a sequence is cut into whole sequences and a rest.  Pieces
are dealt into groups of about ``GROUP_ROWS`` by a hash of their partition and
place there, so neither one doc_id on many rows nor a long document makes a
large group; each group is packed by itself.

Tokenising keeps, in each worker process, the ids of words met before, by a
64-bit hash: the vocabulary's splitting never crosses white space, so a text's
ids are its words' ids in a row.  Words of ASCII alone are known without case;
others, and those with the special tokens' bar, as they are written, since
composing letters and marks comes before lower case.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed each; a piece is never larger than a sequence; a null doc_id is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import U64, HashTable, flat_text, kept, mix64, slices, table, word_hashes, word_spans

CAPACITY = 4096
END = 2
GROUP_ROWS = 4096
VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 500_000
#: Words learnt in one go.
LEARN = 20_000
MARK = "|"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def folded(data: np.ndarray, ws: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, but for words with a byte beyond ASCII or a bar."""
    odd = np.flatnonzero((data >= 128) | (data == ord(MARK)))
    low = _LOWER[data]
    if len(odd):
        held = np.zeros(len(ws), bool)
        held[np.searchsorted(ws, odd, "right") - 1] = True
        sizes = np.diff(np.append(ws, len(data)))
        keep = np.concatenate([np.zeros(int(ws[0]), bool), np.repeat(held, sizes)])
        np.copyto(low, data, where=keep)
    return low


class Words:
    """The token ids of words, found once per process, by their hashes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        """Word 0 is the end token."""
        self.table = HashTable()
        self.ids, self.used = np.full(1 << 16, END, np.uint32), 1
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64), 1

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each word's number of ids.

        Words without a bar go through the tokenizer as one text, with a bar
        between them that is one id by itself and in none of them.
        """
        if any(MARK in w for w in words):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join([*words, ""])], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words):
            raise ValueError("the vocabulary doesn't keep the bar apart")
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        barred = np.array([MARK in w for w in words], bool)
        for part in (np.flatnonzero(~barred), np.flatnonzero(barred)):
            for k in range(0, len(part), LEARN):
                at = part[k : k + LEARN]
                flat, sizes = self._encoded([words[i] for i in at.tolist()])
                n, total = self.count + len(at), self.used + len(flat)
                if total > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
                if n > len(self.start):
                    more = np.zeros(max(n, len(self.start)), np.int64)
                    self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
                self.ids[self.used : total] = flat
                self.size[self.count : n] = sizes
                self.start[self.count : n] = self.used + np.cumsum(sizes) - sizes
                self.table.enter(h[at], np.arange(self.count, n, dtype=np.int32))
                self.count, self.used = n, total

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by END, and their offsets."""
        if self.count > WORDS_KEPT:
            self.clear()
        ws, wo = word_spans(data, offs)
        if len(ws):
            h = word_hashes(folded(data, ws), ws, lower=False)
            h[h == 0] = U64(1)
            k = self.table.find(h)
            new, first = np.unique(h[k < 0], return_index=True)
            if len(new):
                at = np.flatnonzero(k < 0)[first]
                ends = np.append(ws[1:], len(data))
                self._learn(new, [data[a:b].tobytes().decode("utf-8", "surrogatepass").strip(" \t\n\x0b\x0c\r") for a, b in zip(ws[at].tolist(), ends[at].tolist(), strict=True)])
                missing = np.flatnonzero(k < 0)
                k[missing] = self.table.find(h[missing])
        else:
            k = np.zeros(0, np.int32)
        k = np.insert(k, wo[1:], 0)
        size = self.size[k]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[k] - at[:-1], size) + np.arange(at[-1])]
        return ids, at[np.concatenate([[0], wo[1:] + np.arange(1, len(wo))])]


def token_ids(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids of each text, followed by END."""
    ids, at = kept(("words", path), lambda: Words(path)).encode(*flat_text(pa.array(texts, pa.string())))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield ids[a:b]


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, the largest first, each into the first bin that has room.

    A tournament tree holds, above each pair of bins, the larger free room; the
    first bin with room is found from the root.
    """
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[k]), 1
        while node < leaves:
            node = 2 * node if free[2 * node] >= size else 2 * node + 1
        bins[k], offsets[k] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node >>= 1
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def _pieces(b: pa.RecordBatch, capacity: int, path: str) -> list[np.ndarray]:
    """For each piece of the rows: the row, start, length, crc32 and the document's number of ids."""
    ids, at = kept(("words", path), lambda: Words(path)).encode(*flat_text(b.column("text")))
    ids = ids.astype("<u4", copy=False)
    size = np.diff(at)
    parts = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), parts)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
    length = np.minimum(size[row] - start, capacity)
    first = at[row] + start
    crc = np.array([zlib.crc32(ids[x:y]) for x, y in zip(first.tolist(), (first + length).tolist(), strict=True)], np.int64)
    return [row, start, length, crc, size[row]]


def _piece_columns(b: pa.RecordBatch, capacity: int, path: str) -> list[pa.Array]:
    row, *rest = _pieces(b, capacity, path)
    return [b.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each document's pieces, in place."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays(_piece_columns(b, capacity, path), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 1, path: str | None = None) -> DataFrame:
    """Each document's pieces with the sequence and the place there: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    groups, path = max(1, -(-docs.count() // group_rows)), path or vocabulary_path()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, task = 0, TaskContext.get().partitionId()
        with np.errstate(over="ignore"):
            salt = mix64(np.array([seed], U64) * U64(1_000_003) + U64(task))
        for b in (part for batch in batches for part in slices(batch)):
            columns = _piece_columns(b, capacity, path)
            n = len(columns[0])
            with np.errstate(over="ignore"):
                group = mix64(salt + np.arange(done, done + n, dtype=U64)) % U64(groups)
            done += n
            yield pa.RecordBatch.from_arrays([*columns, pa.array(group.astype(np.int64))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length")])
        bins, offsets = first_fit_decreasing(np.asarray(t.column("length")), capacity)
        base = np.asarray(t.column("group"))[0] << 32
        return t.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    dealt = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(deal, PIECES + ", group long")
    return dealt.groupBy("group").applyInArrow(fit, PACKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
