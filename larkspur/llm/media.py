"""Media columns: telephony audio kept losslessly, expanded and resampled.

8-bit companded samples live in WAV containers in a binary column, as they are
or as resampled 16-bit PCM.  Mu-law and A-law expand through 256-entry tables
that are computed from their formulas; IMA ADPCM blocks are decoded with numpy,
one step of all blocks at a time; PCM is resampled by linear interpolation,
which leaves the given samples in their places.  A-law codes all differ when
expanded, so that PCM made of them leads back to every code.  A batch of rows
is processed at once, and a row is never split, so memory is bounded by a batch
and its longest row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

BLOCK = 64
PCM, ALAW, ULAW, IMA = 1, 6, 7, 0x11
#: Samples of stored PCM for each one given.
UP = 2

# Fixed values of the IMA ADPCM format.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def ulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = ((((code & 15).astype(np.int32) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent = ((code >> 4) & 7).astype(np.int32)
    size = ((code & 15).astype(np.int32) << 4) + np.where(exponent > 0, 0x108, 8)
    size = size << np.maximum(exponent - 1, 0)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 times the step index plus nibble: the difference, and 16 times the next index."""
    step = np.array(STEP_SIZES, np.int32)[:, None]
    nibble = np.arange(16)[None, :]
    size = step >> 3
    for bit in range(3):
        size = size + np.where(nibble & (4 >> bit), step >> bit, 0)
    following = np.clip(np.arange(89)[:, None] + np.array(INDEX_STEPS * 2)[None, :], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


ULAW_TABLE, ALAW_TABLE = ulaw_table(), alaw_table()
IMA_DIFFERENCE, IMA_NEXT = ima_tables()
#: The A-law code of each 16-bit sample that is one expanded.
ALAW_CODES = np.zeros(1 << 16, np.uint8)
ALAW_CODES[ALAW_TABLE.view(np.uint16)] = np.arange(256)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (one a row), all blocks in step.

    A block starts with its first sample (two bytes, little-endian), its step
    index (taken as at most 88) and a reserved byte.
    """
    head = blocks[:, :4]
    sample = (head[:, 0].astype(np.int32) | (head[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = sample
    for i, pair in enumerate(body):
        for half, nibble in enumerate((pair & 15, pair >> 4)):
            key = index + nibble
            sample = sample + IMA_DIFFERENCE[key]
            np.clip(sample, -32768, 32767, out=sample)
            index = IMA_NEXT[key]
            out[1 + 2 * i + half] = sample
    return out.T


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """16-bit PCM at ``up`` times the rate, by linear interpolation."""
    wide = pcm.astype(np.int32)
    ahead = np.append(wide[1:], wide[-1:])
    out = np.empty(len(wide) * up, np.int16)
    for k in range(up):
        out[k::up] = (wide * (up - k) + ahead * k) // up
    return out


def wav(data: bytes, kind: int, rate: int = 8000, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF/WAVE file; odd data gets the format's padding byte."""
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * bits // 8, align, bits, 0)
    body = b"".join((b"WAVE", b"fmt ", struct.pack("<I", len(form)), form, b"data", struct.pack("<I", len(data)), data, b"\0" * (len(data) % 2)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Format tag and sample bytes of a WAV file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return kind, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_pcm(media: bytes) -> np.ndarray:
    """16-bit PCM of a stored file, whichever of the three codecs it has."""
    kind, data = read_wav(media)
    raw = np.frombuffer(data, np.uint8)
    if kind == IMA:
        return decode_ima(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    if kind == PCM:
        return np.frombuffer(data, "<i2")
    return {ULAW: ULAW_TABLE, ALAW: ALAW_TABLE}[kind][raw]


def payload_of(media: bytes) -> bytes:
    """The samples that were stored: those of a companded file, or the A-law codes that PCM was made of."""
    kind, data = read_wav(media)
    return ALAW_CODES[np.frombuffer(data, "<u2")[::UP]].tobytes() if kind == PCM else data


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes (null: none) and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def _expanded(data: bytes) -> bytes:
    """A-law samples as a WAV file of 16-bit PCM at ``UP`` times the rate."""
    pcm = resample(ALAW_TABLE[np.frombuffer(data, np.uint8)], UP)
    return wav(pcm.astype("<i2").tobytes(), PCM, 8000 * UP, 16, 2)


def store_pcm(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media`` of every row, written and reread.

    The UTF-8 text (null: empty), padded with zero bytes to a positive multiple
    of 64, is taken as A-law samples and stored as resampled 16-bit PCM in a WAV
    file, from which :func:`payload_of` reads it back byte by byte.  Repeated
    rows are rows of their own; other columns are left behind whatever their
    names.
    """
    return _stored_media(docs, text, doc_id, _expanded)


def store_payloads(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same with the payload as the samples of a mu-law WAV file."""
    return _stored_media(docs, text, doc_id, lambda data: wav(data, ULAW))


def _stored_media(docs: DataFrame, text: str, doc_id: str, form: Callable[[bytes], bytes]) -> DataFrame:

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, size=4 << 20):
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            media = pa.array([form(padded(t)) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(pack, "doc_id long, n_bytes long, media binary"), "media")


def resampled(media: DataFrame, up: int = 2) -> DataFrame:
    """``media`` with ``pcm``: its samples at ``up`` times the rate, as 16-bit PCM bytes."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for i, m in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([None if m is None else resample(to_pcm(m), up).tobytes()], pa.binary())], ["doc_id", "pcm"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(expand, "doc_id long, pcm binary")


def _loudness(samples: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.abs(samples.astype(np.int64)), bounds)


def describe(media: DataFrame) -> DataFrame:
    """Digests and audio features of stored payloads, from the bytes read back.

    ``feature`` joins the summed loudness of the samples taken as mu-law, as
    A-law and as IMA ADPCM blocks, and the CRC-32 of the resampled PCM: that
    which is stored, or that which a companded file gives.  Null ids stay null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, size=8 << 20):
            yield part(batch, batch.column(2).to_pylist())

    def part(batch: pa.RecordBatch, files: list[bytes]) -> pa.RecordBatch:
        payloads = [payload_of(m) for m in files]
        raw = np.frombuffer(b"".join(payloads), np.uint8)
        sizes = np.array([len(p) for p in payloads])
        bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ulaw = ULAW_TABLE[raw]
        blocks = np.abs(decode_ima(raw.reshape(-1, BLOCK)).astype(np.int32)).sum(axis=1, dtype=np.int64)
        ima = np.add.reduceat(blocks, bounds // BLOCK)
        loud, loud_a = _loudness(ulaw, bounds), _loudness(ALAW_TABLE[raw], bounds)
        crc = [zlib.crc32(data if kind == PCM else resample(to_pcm(m)).tobytes()) for m, (kind, data) in zip(files, map(read_wav, files), strict=True)]
        feature = [f"u{a}-a{b}-i{c}-r{d:08x}" for a, b, c, d in zip(loud, loud_a, ima, crc, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in files], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in files]),
                pa.array(feature),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
