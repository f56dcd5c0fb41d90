"""Media columns: telephony audio.

Mu-law and A-law samples are expanded by lookup tables, IMA ADPCM blocks are
decoded with numpy across blocks (one step of all blocks at a time), and the
16-bit PCM is resampled and stored.  Containers are RIFF WAVE.

Edge cases: null or empty audio has no samples; a file that is cut short gives
the whole samples (for ADPCM: the whole blocks) that are there; a damaged
header gives null PCM; extra columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
BLOCK = 64
#: Fixed values of the IMA ADPCM format: change of the step's index by code, and the steps.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
#: Blocks decoded at a time; bounds memory.
SLAB = 1 << 12
#: Bytes of text and samples worked on at a time.
TEXT_SLICE, SAMPLES = 1 << 19, 1 << 18


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def encode_law(pcm: np.ndarray, law: np.ndarray) -> np.ndarray:
    """The code whose value is nearest to each sample (the lesser value on ties)."""
    order = np.argsort(law, kind="stable")
    values = law[order].astype(np.int32)
    return order[np.searchsorted((values[1:] + values[:-1]) / 2.0, pcm)].astype(np.uint8)


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks: (n, size) bytes to (n, 1 + 2 * (size - 4))."""
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range(2 * (size - 4)):
        byte = blocks[:, 4 + k // 2]
        code = (byte >> 4 if k % 2 else byte & 15).astype(np.int32)
        step = IMA_STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[:, k + 1] = value
    return out


def ima_encode(pcm: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks of PCM, the last one filled up with its last sample; the inverse of ``ima_blocks`` up to its error."""
    each = 1 + 2 * (size - 4)
    n = -(-len(pcm) // each)
    full = np.concatenate([pcm, np.repeat(pcm[-1:], n * each - len(pcm))]).astype(np.int32).reshape(n, each)
    out = np.zeros((n, size), np.uint8)
    value, index = full[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(each - 1):
        step, off = IMA_STEPS[index], full[:, k + 1] - value
        sign, rest = off < 0, np.abs(off)
        code, change = np.zeros(n, np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = rest >= part
            code, rest, change = code + bit * on, rest - part * on, change + part * on
        value = np.clip(value + np.where(sign, -change, change), -32768, 32767)
        code += 8 * sign
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[:, 4 + k // 2] |= (code << (4 * (k % 2))).astype(np.uint8)
    return out


def wav(kind: int, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF WAVE file."""
    bits = {PCM: 16, IMA: 4}.get(kind, 8)
    block = {PCM: 2, IMA: block}.get(kind, 1)
    per_s = rate * 2 if kind == PCM else rate if kind != IMA else rate * block // (1 + 2 * (block - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_s, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(kind, rate, block, data) of a WAVE file; None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            kind, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            fmt = (kind, rate, block)
        elif name == b"data" and fmt:
            return *fmt, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def pcm_of(kind: int, block: int, data) -> np.ndarray | None:
    """The 16-bit samples of what ``read_wav`` found; None for an unknown kind."""
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return MULAW_PCM[raw]
    if kind == ALAW:
        return ALAW_PCM[raw]
    if kind == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    if kind == IMA and block > 4:
        blocks = raw[: len(raw) // block * block].reshape(-1, block)
        return np.concatenate([ima_blocks(blocks[k : k + SLAB]).ravel() for k in range(0, len(blocks), SLAB)]) if len(blocks) else np.zeros(0, np.int16)
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's instants; the last sample holds."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[1:] + wide[:-1]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    low = np.minimum(at.astype(np.int64), len(pcm) - 1)
    part, wide = at - low, pcm.astype(np.float64)
    return np.rint(wide[low] * (1 - part) + wide[np.minimum(low + 1, len(pcm) - 1)] * part).astype(np.int16)


def decode_audio(df: DataFrame, column: str, to: int = 16000, out: str = "pcm") -> DataFrame:
    """Adds the resampled PCM of a column of WAVE files, as a PCM WAVE file; null where the file can't be read."""
    schema = df.drop(out).withColumn(out, df[column].cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, column, TEXT_SLICE)):
            made = []
            for media in b.column(column):
                got = read_wav(media.as_py() or b"")
                pcm = pcm_of(got[0], got[2], got[3]) if got else None
                made.append(None if pcm is None else wav(PCM, resample(pcm, got[1], to).tobytes(), to))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), pa.array(made, pa.binary())], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def payload(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text + b"\0" * (BLOCK * max(1, -(-len(text) // BLOCK)) - len(text))


def _ima_sums(raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of payloads read as ADPCM blocks, so many each: sum of squares, peak and sign changes within blocks."""
    blocks = raw.reshape(-1, BLOCK)
    square, peak, turns = (np.empty(len(blocks), np.int64) for _ in range(3))
    for k in range(0, len(blocks), SLAB):
        pcm = ima_blocks(blocks[k : k + SLAB])
        wide = pcm.astype(np.int64)
        square[k : k + SLAB] = np.einsum("ij,ij->i", wide, wide)
        peak[k : k + SLAB] = np.abs(wide).max(1)
        turns[k : k + SLAB] = ((pcm[:, 1:] < 0) != (pcm[:, :-1] < 0)).sum(1)
    at = np.cumsum(counts) - counts
    return np.add.reduceat(square, at), np.maximum.reduceat(peak, at), np.add.reduceat(turns, at)


def _pcm_feature(kind: int, block: int, data, rate: int) -> str:
    """Digest, root mean square, peak and sign changes of the samples at twice the rate, a stretch at a time.

    A stretch ends with the first sample of the next, which interpolation needs and which isn't counted.
    """
    crc = square = peak = turns = n = 0
    last = None
    for at in range(0, len(data), SAMPLES):
        part = pcm_of(kind, block, data[at : at + SAMPLES + 1])
        more = at + SAMPLES < len(data)
        pcm = resample(part, rate, 2 * rate)
        pcm = pcm[: 2 * (len(part) - 1)] if more else pcm
        crc = zlib.crc32(pcm, crc)
        wide = pcm.astype(np.int64)
        square, peak, n = square + int(wide @ wide), max(peak, int(np.abs(wide).max())), n + len(pcm)
        signs = pcm < 0
        turns += int(np.count_nonzero(signs[1:] != signs[:-1])) + (last is not None and bool(signs[0]) != last)
        last = bool(signs[-1])
    return f"pcm:{crc:08x}:rms={(square / n) ** 0.5:.1f}:peak={peak}:turns={turns}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for part in (part for batch in batches for part in slices(batch, 1, TEXT_SLICE)):
        rows, raws = [], []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            media = wav(MULAW, payload(text))
            kind, rate, block, data = read_wav(media)
            raws.append(np.frombuffer(data, np.uint8))
            rows.append([doc_id, len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), _pcm_feature(kind, block, data, rate)])
        if not rows:
            continue
        for row, square, peak, turns in zip(rows, *_ima_sums(np.concatenate(raws), np.array([len(r) // BLOCK for r in raws])), strict=True):
            row[-1] += f";adpcm:rms={(int(square) / (row[2] // BLOCK * 121)) ** 0.5:.1f}:peak={peak}:turns={turns}"
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op9_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's payload as a mu-law file at 8 kHz; features of its PCM at 16 kHz and of the same bytes read as ADPCM blocks."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return docs.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
