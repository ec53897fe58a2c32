"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM.

A media column holds whole WAV files as binary. read_wav() takes format tags 1 (PCM, 8 or 16 bit), 6 (A-law), 7 (mu-law)
and 17 (IMA ADPCM); samples() gives 16-bit values; resample() changes the rate with integer polyphase filters, so equal
inputs give equal values on any machine; to_pcm() stores the result as 16-bit WAV.

pack_text() stores a text losslessly: its UTF-8 bytes, zero-padded to a positive multiple of 64, are the data of an 8 kHz mono WAV
file, in the format that a checksum of them picks: 8-bit mu-law or A-law samples, or IMA ADPCM blocks of 64 bytes. Reading back gives
exactly these bytes, and the file decoded and resampled to 16 kHz PCM. ADPCM blocks of all files of a batch are decoded together.

Edge cases: a null or empty text is 64 zero bytes; a null media value gives null columns; a media value that is not such
a WAV file gives n_samples null and the reason in `error`; rows repeat as given; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.session import ship

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: Bytes of an ADPCM block of a stored text, and the unit to which texts are padded.
IMA_BLOCK = 64
#: Filter taps on each side of a sample, and the scale of the integer filter values.
HALF_TAPS, SCALE_BITS = 8, 14
#: Samples resampled at a time.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, value = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    value = np.where(exponent > 0, value + 0x100 << np.maximum(exponent - 1, 0), value)
    return np.where(code & 0x80, value, -value).astype(np.int16)


def write_wav(data: bytes, tag: int, rate: int, bits: int, block: int | None = None, extra: bytes = b"") -> bytes:
    """A mono WAV file around data."""
    block = block or bits // 8
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, block, bits) + (struct.pack("<H", len(extra)) + extra if tag != PCM else b"")
    pad = b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, int, memoryview]:
    """(format tag, rate, bits, block size, data) of a mono WAV file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    view, at, fmt = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if n < 16 or at + 24 > len(media):
                raise ValueError("short fmt chunk")
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if fmt is None or fmt[1] != 1:
                raise ValueError("no mono fmt chunk before data")
            if at + 8 + n > len(media):
                raise ValueError("data chunk is cut off")
            return fmt[0], fmt[2], fmt[5], fmt[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def decode_ima(data: bytes | memoryview, block: int) -> np.ndarray:
    """All blocks at once: one pass over the samples of a block, each step on the vector of blocks.

    A last block that is shorter is decoded by itself; bytes that make no whole header are ignored.
    """
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // block
    out = [_ima_blocks(raw[: whole * block].reshape(whole, block)).ravel()] if whole else []
    if len(rest := raw[whole * block :]) >= 4:
        out.append(_ima_blocks(rest.reshape(1, -1)).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.int16)


def _ima_blocks(blocks: np.ndarray) -> np.ndarray:
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * codes.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * codes.shape[1]):
        code = (codes[:, k // 2] >> (4 * (k % 2))).astype(np.int32) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV file."""
    tag, rate, bits, block, data = read_wav(media)
    if tag == MULAW:
        return rate, mulaw_table()[np.frombuffer(data, np.uint8)]
    if tag == ALAW:
        return rate, alaw_table()[np.frombuffer(data, np.uint8)]
    if tag == IMA and bits == 4 and block > 4:
        return rate, decode_ima(data, block)
    if tag == PCM and bits == 16:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if tag == PCM and bits == 8:
        return rate, (np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8
    raise ValueError(f"format tag {tag} with {bits} bits is not supported")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> list[np.ndarray]:
    """Integer filter of each output phase: a windowed sinc, values that sum to 2 ** SCALE_BITS."""
    cut, reach = min(1.0, up / down), max(1.0, down / up)
    half, out = math.ceil(HALF_TAPS * reach), []
    for p in range(up):
        t = np.arange(-half + 1, half + 1) - p / up
        h = np.sinc(t * cut) * np.cos(np.pi * np.clip(t / (2 * half), -0.5, 0.5)) ** 2
        h = np.round(h / h.sum() * (1 << SCALE_BITS)).astype(np.int64)
        h[np.argmax(np.abs(h))] += (1 << SCALE_BITS) - h.sum()
        out.append(h)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """pcm at another rate, by integer polyphase filters, a bounded number of samples at a time."""
    if rate == to or not len(pcm):
        return np.asarray(pcm, np.int16)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    filters = phases(up, down)
    half, total = len(filters[0]) // 2, -(-len(pcm) * up // down)
    padded = np.concatenate([np.zeros(half - 1, np.int16), pcm, np.zeros(half, np.int16)])
    out = np.empty(total, np.int16)
    for p in range(up):  # outputs k with k * down = p (mod up) use the filter of phase p
        k = np.arange(next(k for k in range(up) if k * down % up == p), total, up, dtype=np.int64)
        for at in range(0, len(k), CHUNK):
            part = k[at : at + CHUNK]
            first = part[0] * down // up
            span = padded[first : part[-1] * down // up + 2 * half].astype(np.int32)
            if down == 1 and np.count_nonzero(filters[p]) == 1:  # the filter keeps these samples
                y = span[half - 1 : half - 1 + len(part)]
            else:
                y = np.zeros(len(part), np.int64)
                for j, h in enumerate(filters[p]):
                    if h:
                        y += h * span[j : j + (len(part) - 1) * down + 1 : down]
                y = y + (1 << SCALE_BITS - 1) >> SCALE_BITS
            out[part[0] : part[-1] + 1 : up] = np.clip(y, -32768, 32767)
    return out


def to_pcm(media: bytes, rate: int = 16_000) -> bytes:
    """The stored form: 16-bit mono WAV at the given rate."""
    own, pcm = samples(media)
    return write_wav(resample(pcm, own, rate).astype("<i2").tobytes(), PCM, rate, 16)


def pack_text(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, WAV file whose data are these bytes, zero-padded)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = raw + b"\0" * (max(IMA_BLOCK, -(-len(raw) // IMA_BLOCK) * IMA_BLOCK) - len(raw))
    tag = (MULAW, ALAW, IMA)[zlib.crc32(data) % 3]
    if tag == IMA:
        return len(raw), write_wav(data, IMA, 8000, 4, IMA_BLOCK, struct.pack("<H", 2 * IMA_BLOCK - 7))
    return len(raw), write_wav(data, tag, 8000, 8)


def samples_of(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """samples() of many WAV files; whole ADPCM blocks of one size are decoded at once."""
    out: list = [None] * len(media)
    alike: dict[int, list[int]] = {}
    data: dict[int, memoryview] = {}
    for i, m in enumerate(media):
        tag, rate, bits, block, own = read_wav(m)
        if tag == IMA and bits == 4 and block > 4 and len(own) and len(own) % block == 0:
            alike.setdefault(block, []).append(i)
            data[i], out[i] = own, (rate, None)
        else:
            out[i] = samples(m)
    for block, places in alike.items():
        counts = [len(data[i]) // block * (2 * block - 7) for i in places]
        pcm = decode_ima(b"".join(data[i] for i in places), block)
        for i, part in zip(places, np.split(pcm, np.cumsum(counts)[:-1]), strict=True):
            out[i] = (out[i][0], part)
    return out


def feature(pcm: np.ndarray, rate: int) -> str:
    """rate:samples:peak:mean magnitude:zero crossings, integers only."""
    if not len(pcm):
        return f"{rate}:0:0:0:0"
    size = np.abs(pcm.astype(np.int32))
    negative = pcm < 0
    return f"{rate}:{len(pcm)}:{int(size.max())}:{int(size.sum(dtype=np.int64)) // len(pcm)}:{int(np.count_nonzero(negative[1:] != negative[:-1]))}"


def store_pcm(df: DataFrame, id_col: str, media_col: str, rate: int = 16_000) -> DataFrame:
    """(id, pcm binary, n_samples long, feature string, error string) of each media value."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None
        try:
            own, pcm = samples(media)
        except ValueError as e:
            return None, None, None, str(e)
        pcm = resample(pcm, own, rate)
        return write_wav(pcm.astype("<i2").tobytes(), PCM, rate, 16), len(pcm), feature(pcm, rate), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [one(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string())))], [id_col, "pcm", "n_samples", "feature", "error"])

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, pcm binary, n_samples long, feature string, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as telephony audio."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [pack_text(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_back(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of what store_texts() made, from the stored bytes alone: of the data, of the file, and of the 16 kHz PCM file."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                files = part.column(2).to_pylist()
                for media, (own, decoded) in zip(files, samples_of(files), strict=True):
                    tag, data = read_wav(media)[0], bytes(read_wav(media)[4])
                    pcm = resample(decoded, own, 16_000)
                    stored = write_wav(pcm.astype("<i2").tobytes(), PCM, 16_000, 16)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pcm, 16_000), tag, hashlib.sha256(stored).hexdigest()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format_tag", "pcm_sha256"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [id_col, "n_bytes", *names])

    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format_tag int, pcm_sha256 string")
