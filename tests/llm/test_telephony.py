"""Lossless storage of texts, table expansion, ADPCM against a plain decoder, resampling."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from quernstone.llm import telephony as t


def test_tables_hold_known_values():
    assert t.mulaw_table()[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert t.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in (t.mulaw_table(), t.alaw_table()):
        assert np.array_equal(np.sort(table), np.sort(-table))


def plain_ima(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<hB", block)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_ima_blocks_equal_a_plain_decoder():
    rng = np.random.default_rng(2)
    raw = bytearray(rng.integers(0, 256, 5 * 36 + 20, np.uint8).tobytes())
    for i in range(0, len(raw), 36):
        raw[i + 2] %= 89
    expected = [v for i in range(0, len(raw), 36) for v in plain_ima(bytes(raw[i : i + 36]))]
    assert t.decode_ima(bytes(raw), 36).tolist() == expected
    wav = t.write_wav(bytes(raw[:180]), t.IMA, 8000, 4, 36, struct.pack("<H", 65))
    assert t.samples(wav)[1].tolist() == expected[: 5 * 65]


def test_resampling_keeps_a_tone_and_its_length():
    x = np.round(8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)).astype(np.int16)
    up = t.resample(x, 8000, 16000)
    assert len(up) == 16000 and np.array_equal(up[::2], x)
    ideal = 8000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(up - ideal)[100:-100].max() < 120
    assert len(t.resample(x, 8000, 11025)) == 11025 and len(t.resample(x[:1], 8000, 6000)) == 1


def test_texts_come_back(spark):
    texts = [None, "", "a" * 64, "é" * 1000, "\x00x", "y" * 200_000, *(f"text {i} " * i for i in range(1, 20))]
    assert {t.read_wav(t.pack_text(x)[1])[0] for x in texts} == {t.MULAW, t.ALAW, t.IMA}
    rows = [(i, x, b"clash") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    for r in t.read_back(t.store_texts(df)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes > len(padded)
        _, media = t.pack_text(texts[r.doc_id])
        assert r.format_tag == (t.MULAW, t.ALAW, t.IMA)[zlib.crc32(padded) % 3] == t.read_wav(media)[0]
        assert (r.media_sha256, r.pcm_sha256) == (hashlib.sha256(media).hexdigest(), hashlib.sha256(t.to_pcm(media)).hexdigest())
    assert t.read_back(t.store_texts(df.limit(0))).collect() == []


def test_media_columns(spark):
    good = t.write_wav(bytes(range(256)), t.ALAW, 8000, 8)
    out = {r.id: r for r in t.store_pcm(spark.createDataFrame([(1, good), (2, b"no wav"), (3, None)], "id long, media binary"), "id", "media").collect()}
    assert out[1].n_samples == 512 and out[1].error is None and t.samples(out[1].pcm)[0] == 16000
    assert out[2].pcm is None and "RIFF" in out[2].error
    assert out[3].pcm is None and out[3].error is None


@pytest.mark.parametrize("media", [b"", b"RIFF", b"RIFF\0\0\0\0WAVEdata\xff\0\0\0", t.write_wav(b"xx", 99, 8000, 8)])
def test_bad_media(media):
    with pytest.raises(ValueError):
        t.samples(media)
