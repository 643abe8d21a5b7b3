"""Telephony audio columns: G.711 expansion, IMA ADPCM block decoding, resampled PCM storage.

The 8-bit stored form is a RIFF/WAVE container with mu-law samples (format tag 7, 8 kHz, mono). Beside it the
table holds its PCM at PCM_RATE, 16 bits a sample, in a lifted form: the even samples as they are, and the odd
ones less what the resampling filter makes of the even ones around them. That loses nothing of any PCM; of PCM
that this filter doubled, the second part is zeros, which the table's compression makes small.

Defined results: a null or empty text is the payload of 64 zero bytes; equal texts give equal media;
repeated rows each give a row; other columns of the input are not read, so their names cannot clash;
an empty table gives an empty result. A row's media is bounded by its own text, a decoder's working
set by CHUNK_BLOCKS blocks.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, materialize, text_rows

PAD = 64
RATE = 8000
PCM_RATE = 16000
#: Blocks decoded at once, across documents.
CHUNK_BLOCKS = 1 << 15
#: Bytes of media and PCM that a task hands on at once.
FRAME_BYTES = 2 << 20
#: Compression of the media table.
LEVEL = 9
#: Taps on each side of the resampling filter.
HALF = 5
TAP_BITS = 14

# Fixed values of the IMA ADPCM standard: quantiser steps and index changes.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
     107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
     876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
     4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
     22385, 24623, 27086, 29794, 32767], dtype=np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For (index, nibble), flattened: the signed change of the predictor and the next index."""
    step, nibble = IMA_STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    follow = np.clip(np.arange(len(IMA_STEPS), dtype=np.int32)[:, None] + IMA_INDEX[nibble & 7], 0, len(IMA_STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (follow * 16).astype(np.int32).ravel()


MULAW, ALAW = _mulaw_table(), _alaw_table()
IMA_CHANGE, IMA_FOLLOW = _ima_tables()


def expand_mulaw(data: bytes) -> np.ndarray:
    """16-bit PCM of mu-law bytes, by table."""
    return MULAW[np.frombuffer(data, np.uint8)]


def expand_alaw(data: bytes) -> np.ndarray:
    """16-bit PCM of A-law bytes, by table."""
    return ALAW[np.frombuffer(data, np.uint8)]


def decode_ima(data: bytes | np.ndarray, block: int = PAD) -> np.ndarray:
    """16-bit PCM, one row a block, of mono IMA ADPCM blocks of `block` bytes.

    All blocks advance together: the loop runs over the nibbles of one block, each step is one
    vectorised table lookup over every block. A length that isn't a multiple of `block` is an error.
    """
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if block < 5 or raw.size % block:
        raise ValueError("ADPCM data must be whole blocks of at least five bytes")
    blocks = raw.reshape(-1, block)
    out = np.empty((2 * (block - 4) + 1, len(blocks)), np.int16)
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k, column in enumerate(columns):
        for half, nibble in enumerate((column & 15, column >> 4)):
            at = index + nibble
            value += IMA_CHANGE[at]
            np.clip(value, -32768, 32767, out=value)
            index = IMA_FOLLOW[at]
            out[2 * k + half + 1] = value
    return out.T


@lru_cache(maxsize=8)
def _kernel(up: int, down: int) -> np.ndarray:
    """Windowed-sinc filter, one row of 2*HALF taps for each phase, in units of 2**-TAP_BITS that add up to 1."""
    cut = min(1.0, up / down)
    offset = np.arange(-HALF + 1, HALF + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(offset * cut) * cut * np.cos(np.pi * offset / (2 * HALF)) ** 2
    whole = np.rint(taps / taps.sum(axis=1, keepdims=True) * (1 << TAP_BITS)).astype(np.int32)
    whole[np.arange(up), np.abs(whole).argmax(axis=1)] += (1 << TAP_BITS) - whole.sum(axis=1)
    return whole


def _rounded(total: np.ndarray) -> np.ndarray:
    return np.clip((total + (1 << TAP_BITS - 1)) >> TAP_BITS, -32768, 32767).astype(np.int16)


def _phase(pcm: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The filter's output of one phase behind each sample."""
    padded = np.concatenate([np.zeros(HALF - 1, np.int32), pcm.astype(np.int32), np.zeros(HALF, np.int32)])
    total = np.zeros(len(pcm), np.int32)
    for k, tap in enumerate(taps):
        if tap:
            total += tap * padded[k : k + len(pcm)]
    return _rounded(total)


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Resample 16-bit PCM by a polyphase windowed-sinc filter in whole numbers, so that every machine gives the
    same samples; the length is ceil(n * target / source)."""
    if source == target or not len(pcm):
        return pcm.astype(np.int16)
    common = math.gcd(source, target)
    up, down = target // common, source // common
    kernel = _kernel(up, down)
    if down == 1 and up <= 8:
        return np.stack([_phase(pcm, kernel[phase]) for phase in range(up)], axis=1).ravel()
    n = -(-len(pcm) * up // down)
    padded = np.concatenate([np.zeros(HALF - 1, np.int32), pcm.astype(np.int32), np.zeros(HALF + 1, np.int32)])
    at = np.arange(n, dtype=np.int64) * down
    base, phase = at // up, at % up
    total = np.zeros(n, np.int32)
    for tap in range(2 * HALF):
        total += kernel[phase, tap] * padded[base + tap]
    return _rounded(total)


def wav(tag: int, data: bytes, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF/WAVE file of `data` under the format `tag` (1 PCM, 6 A-law, 7 mu-law, 17 IMA ADPCM)."""
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if tag == 17 else b"\0\0"
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * align if tag != 17 else rate * align // (2 * (align - 4) + 1), align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwav(file: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, sample bytes) of a RIFF/WAVE file; malformed files are errors."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", file, at + 8)
            form = (tag, rate, align)
        elif name == b"data" and form:
            return *form, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples in the file")


def to_pcm(file: bytes, rate: int = PCM_RATE) -> np.ndarray:
    """The file's samples as 16-bit PCM at `rate`: mu-law, A-law, IMA ADPCM or PCM by its format tag."""
    tag, own, align, data = unwav(file)
    if tag == 7:
        pcm = expand_mulaw(data)
    elif tag == 6:
        pcm = expand_alaw(data)
    elif tag == 17:
        raw = np.frombuffer(data, np.uint8)
        step = align * CHUNK_BLOCKS
        parts = [decode_ima(raw[i : i + step], align).ravel() for i in range(0, raw.size, step)]
        pcm = np.concatenate(parts) if parts else np.zeros(0, np.int16)
    elif tag == 1:
        pcm = np.frombuffer(data, "<i2")
    else:
        raise ValueError(f"unknown format tag {tag}")
    return resample(pcm, own, rate)


def payload(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, payload) of a text: its UTF-8 bytes and zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(data), data + b"\0" * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def _between(even: np.ndarray) -> np.ndarray:
    """What the filter puts behind each of these samples when it doubles their rate."""
    return _phase(even, _kernel(2, 1)[1])


def lift(pcm: np.ndarray) -> tuple[bytes, bytes]:
    """(even samples, odd samples less their prediction modulo 2**16) of 16-bit PCM, little-endian."""
    even = pcm[::2].astype("<i2")
    odd = pcm[1::2].astype(np.int16).view(np.uint16) - _between(even)[: len(pcm) // 2].view(np.uint16)
    return even.tobytes(), odd.astype("<u2").tobytes()


def unlift(even: bytes, odd: bytes) -> np.ndarray:
    """The PCM of its lifted form."""
    first, rest = np.frombuffer(even, "<i2"), np.frombuffer(odd, "<u2")
    out = np.empty(len(first) + len(rest), np.int16)
    out[::2] = first
    out[1::2] = (rest + _between(first)[: len(rest)].view(np.uint16)).view(np.int16)
    return out


MEDIA_SCHEMA = "doc_id string, n_bytes long, media binary, pcm_rate int, pcm_even binary, pcm_odd binary"


def _media_rows(files: Iterator[tuple[str | None, int | None, bytes | None]], rate: int) -> Iterator[pd.DataFrame]:
    """Rows of the media table for (doc_id, n_bytes, file), in frames of about FRAME_BYTES."""
    rows, size = [], 0
    for doc_id, n, file in files:
        even, odd = lift(to_pcm(file, rate)) if file is not None else (None, None)
        rows.append((doc_id, n, file, rate, even, odd))
        size += len(file or b"") + 2 * len(even or b"")
        if size >= FRAME_BYTES:
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media", "pcm_rate", "pcm_even", "pcm_odd"])
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media", "pcm_rate", "pcm_even", "pcm_odd"])


def store_texts(docs: DataFrame, rate: int = PCM_RATE, label: str = "telephony") -> DataFrame:
    """Write (doc_id, n_bytes, media, pcm_rate, pcm_even, pcm_odd) to the shared folder, media being the mu-law file
    of the text's payload and the rest its resampled PCM, and return the table as read back."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads = ((i, *payload(x)) for i, x in zip(batch["doc_id"], batch["text"]))
            yield from _media_rows(((i, n, wav(7, x)) for i, n, x in payloads), rate)

    return materialize(id_back(text_rows(docs).mapInPandas(pack, MEDIA_SCHEMA)), label, level=LEVEL)


def store_pcm(media: DataFrame, rate: int = PCM_RATE, label: str = "pcm") -> DataFrame:
    """Write the files of (doc_id, media), mu-law, A-law, ADPCM or PCM by their format tags, with their PCM at
    `rate` to the shared folder, in the columns of store_texts; n_bytes is null."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = ((i, None, None if x is None else bytes(x)) for i, x in zip(batch["doc_id"], batch["media"]))
            for rows in _media_rows(files, rate):
                yield rows.astype({"n_bytes": "Int64"})

    rows = media.select(F.col("doc_id").cast("string").alias("doc_id"), "media").mapInPandas(convert, MEDIA_SCHEMA)
    return materialize(id_back(rows), label, level=LEVEL)


def describe(data: bytes, adpcm: np.ndarray, stored: np.ndarray) -> str:
    """Loudness, peak and sign changes of the mu-law samples, and checksums of the bytes read as A-law and as ADPCM
    blocks, and of the stored PCM."""
    pcm = expand_mulaw(data)
    wide = pcm.astype(np.int64)
    rms = math.isqrt(int((wide * wide).sum()) // len(wide))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    sums = (zlib.crc32(x.astype("<i2").tobytes()) for x in (expand_alaw(data), adpcm, stored))
    return f"rms={rms};peak={int(np.abs(wide).max())};turns={turns};" + ";".join(f"{k}={v:08x}" for k, v in zip(("alaw", "ima", "pcm"), sums))


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media and PCM, from the bytes read back. A null media is an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [bytes(x) for x in batch["media"]]
            data = [unwav(x)[3] for x in files]
            stored = [unlift(bytes(x), bytes(y)) for x, y in zip(batch["pcm_even"], batch["pcm_odd"])]
            rows, start = [], 0
            while start < len(data):  # documents are decoded together, up to a bounded number of blocks
                end, blocks = start, 0
                while end < len(data) and (end == start or blocks + len(data[end]) // PAD <= CHUNK_BLOCKS):
                    blocks += len(data[end]) // PAD
                    end += 1
                joined, at = np.frombuffer(b"".join(data[start:end]), np.uint8), 0
                step = PAD * CHUNK_BLOCKS
                decoded = [decode_ima(joined[i : i + step]) for i in range(0, joined.size, step)]
                decoded = decoded[0] if len(decoded) == 1 else np.concatenate(decoded)
                for x, pcm in zip(data[start:end], stored[start:end]):
                    rows.append(describe(x, decoded[at : at + len(x) // PAD].ravel(), pcm))
                    at += len(x) // PAD
                start = end
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "payload_bytes": [len(x) for x in data],
                    "payload_sha256": [hashlib.sha256(x).hexdigest() for x in data], "tail_crc32": [zlib.crc32(x[-PAD:]) for x in data],
                    "media_bytes": [len(x) for x in files], "media_sha256": [hashlib.sha256(x).hexdigest() for x in files], "feature": rows,
                }
            )

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return id_back(media.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media", "pcm_even", "pcm_odd").mapInPandas(read, schema))
