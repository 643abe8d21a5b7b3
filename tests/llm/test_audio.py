import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from corpusloom.llm import audio


def slow_mulaw(b):
    b = ~b & 0xFF
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return -size if b & 128 else size


def slow_ima(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            change = step >> 3
            for bit, part in ((1, 2), (2, 1), (4, 0)):
                change += step >> part if nibble & bit else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(audio.IMA_INDEX[nibble & 7])))
            out.append(value)
    return out


def test_tables_follow_the_standard():
    assert [int(x) for x in audio.MULAW] == [slow_mulaw(b) for b in range(256)]
    assert audio.MULAW[0] == -32124 and audio.MULAW[255] == 0 and audio.MULAW[128] == 32124
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0xAA] == 32256 and len(set(audio.ALAW.tolist())) == 256


def test_adpcm_blocks_decode_as_one_by_one():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 64 * 50, dtype=np.uint8)
    got = audio.decode_ima(data)
    assert got.tolist() == [slow_ima(bytes(data[i : i + 64])) for i in range(0, len(data), 64)]
    assert audio.decode_ima(b"").shape == (0, 121)
    with pytest.raises(ValueError):
        audio.decode_ima(b"x" * 63)


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    for rate in (16000, 24000, 11025, 4000):
        got = audio.resample(tone, 8000, rate)
        assert len(got) == -(-800 * rate // 8000)
        want = 8000 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / rate)
        assert np.abs(got - want)[50:-50].max() < 300
    assert audio.resample(tone, 8000, 8000).tolist() == tone.tolist() and not len(audio.resample(tone[:0], 8000, 16000))


def test_containers_round_trip():
    for tag in (1, 6, 7):
        assert audio.unwav(audio.wav(tag, b"abcde"))[::3] == (tag, b"abcde")
    assert len(audio.to_pcm(audio.wav(17, bytes(128), align=64), 8000)) == 2 * 121
    for bad in (b"", b"RIFFxxxxWAVE", b"junk" * 20):
        with pytest.raises(ValueError):
            audio.unwav(bad)


def test_contract_against_plain_python(nasty, none):
    got = {}
    for r in audio.media_features(audio.store_texts(nasty)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for r in nasty.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in texts.items()}
    for key, rows in got.items():
        data = (texts[key][0] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(audio.wav(7, padded)).hexdigest()
    assert got[0][0]["feature"] == got[1][0]["feature"] and got[3][0]["feature"] == got[4][0]["feature"]
    assert audio.media_features(audio.store_texts(none)).count() == 0


def slow_alaw(b):
    b ^= 0x55
    size, segment = (b & 15) * 16 + 8, b >> 4 & 7
    size = size if segment == 0 else (size + 256) << segment - 1
    return size if b & 128 else -size


def slow_double(pcm):
    """Twice the rate: each sample, and what ten samples around say lies behind it."""
    taps = [round(float(x)) for x in audio._kernel(2, 1)[1]]
    out = []
    for k, x in enumerate(pcm):
        near = [pcm[j] if 0 <= j < len(pcm) else 0 for j in range(k - audio.HALF + 1, k + audio.HALF + 1)]
        out += [x, max(-32768, min(32767, sum(a * b for a, b in zip(taps, near)) + (1 << audio.TAP_BITS - 1) >> audio.TAP_BITS))]
    return out


def test_features_against_plain_python(nasty):
    few = nasty.where("doc_id in (0, 4, 5, 8, 10, 12)").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    for r in audio.media_features(audio.store_texts(few)).collect():
        data = audio.payload(texts[r["doc_id"]])[1]
        pcm = [slow_mulaw(b) for b in data]
        rms, peak = math.isqrt(sum(x * x for x in pcm) // len(pcm)), max(map(abs, pcm))
        turns = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:]))
        ima = [v for i in range(0, len(data), 64) for v in slow_ima(data[i : i + 64])]
        crc = lambda x: f"{zlib.crc32(struct.pack(f'<{len(x)}h', *x)):08x}"
        want = f"rms={rms};peak={peak};turns={turns};alaw={crc([slow_alaw(b) for b in data])};ima={crc(ima)};pcm={crc(slow_double(pcm))}"
        assert r["feature"] == want


def test_stored_pcm_is_the_resampled_expansion(nasty):
    media = audio.store_texts(nasty.where("doc_id = 10"))
    want = audio.resample(audio.expand_mulaw(audio.payload("a b c")[1]), 8000, 16000).tolist()
    for row in (media.first(), audio.store_pcm(media).first()):
        assert row["pcm_rate"] == 16000 and audio.unlift(bytes(row["pcm_even"]), bytes(row["pcm_odd"])).tolist() == want
        assert not any(row["pcm_odd"])
    assert want == slow_double([slow_mulaw(b) for b in audio.payload("a b c")[1]])


def test_all_formats_are_stored_at_one_rate(spark):
    rng = np.random.default_rng(3)
    files = [audio.wav(7, rng.bytes(64)), audio.wav(6, rng.bytes(63)), audio.wav(17, rng.bytes(128), align=64), audio.wav(1, rng.bytes(500), 11025, 16, 2), None]
    frame = spark.createDataFrame([(2**60 + k, x, "clash") for k, x in enumerate(files)], "doc_id long, media binary, pcm_rate string")
    got = {r["doc_id"] - 2**60: r for r in audio.store_pcm(frame).collect()}
    assert len(got) == len(files) and got[4]["pcm_even"] is None
    for k, file in enumerate(files[:4]):
        assert audio.unlift(bytes(got[k]["pcm_even"]), bytes(got[k]["pcm_odd"])).tolist() == audio.to_pcm(file, 16000).tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 999])
def test_lifting_loses_nothing(n):
    pcm = np.random.default_rng(n).integers(-32768, 32768, n).astype(np.int16)
    assert audio.unlift(*audio.lift(pcm)).tolist() == pcm.tolist()
    pcm = np.where(np.arange(n) % 3 == 0, 32767, -32768).astype(np.int16)
    assert audio.unlift(*audio.lift(pcm)).tolist() == pcm.tolist()
