"""Audio against a scalar version of every step."""

import hashlib
import random
import struct
import zlib
from fractions import Fraction
from math import floor, isqrt

import numpy as np
import pytest

from riskloom.llm import media


def mulaw(byte: int) -> int:
    byte ^= 0xFF
    size = (((byte & 15) * 2 + 33) << (byte >> 4 & 7)) - 33
    return -4 * size if byte & 128 else 4 * size


def alaw(byte: int) -> int:
    byte ^= 0x55
    segment, low = byte >> 4 & 7, byte & 15
    size = 2 * low + 1 if segment == 0 else (2 * low + 33) << segment - 1
    return 8 * size if byte & 128 else -8 * size


def ima(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (2 * (code & 7) - 6 if code & 4 else -1)))
            out.append(value)
    return out


def resampled(pcm: list[int], rate: int, to: int) -> list[int]:
    out = []
    for k in range(len(pcm) * to // rate):
        at = Fraction(k * rate, to)
        a = pcm[floor(at)]
        b = pcm[min(floor(at) + 1, len(pcm) - 1)]
        out.append(floor(a + (b - a) * (at - floor(at))))
    return out


def test_tables():
    assert media.MULAW.tolist() == [mulaw(b) for b in range(256)]
    assert media.ALAW.tolist() == [alaw(b) for b in range(256)]


def test_blocks_by_scalar_decoding():
    rng = random.Random(3)
    blocks = [rng.randbytes(64) for _ in range(60)] + [b"\0" * 64, b"\xff" * 64, b"\xff\x7f\x58\0" + b"\x77" * 60, b"\x00\x80\x58\0" + b"\xff" * 60]
    assert media.decode_ima(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64)).tolist() == [ima(b) for b in blocks]


@pytest.mark.parametrize("rate,to", [(8000, 16000), (8000, 24000), (8000, 11025), (11025, 8000), (8000, 8000)])
def test_resampling_by_fractions(rate, to):
    rng = random.Random(4)
    for n in (0, 1, 2, 64, 301):
        pcm = [rng.choice([-32768, 32767, rng.randint(-32768, 32767)]) for _ in range(n)]
        assert media.resample(np.array(pcm, np.int16), rate, to).tolist() == resampled(pcm, rate, to)


def test_wav_round_trip():
    for codec, data in (("mulaw", b"a" * 64), ("alaw", b"b" * 63), ("ima", b"c" * 128), ("pcm", b"d" * 6)):
        assert media.unwav(media.wav(data, codec)) == (codec, 8000, data)
    for bad in (b"", b"RIFF", media.wav(b"x" * 64, "mulaw")[:20], media.wav(b"x" * 64, "mulaw").replace(b"WAVE", b"WAVX")):
        with pytest.raises(ValueError):
            media.unwav(bad)


def scalar(raw: bytes) -> dict:
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    codec = ("mulaw", "alaw", "ima")[zlib.crc32(payload) % 3]
    if codec == "ima":
        pcm = [v for i in range(0, len(payload), 64) for v in ima(payload[i : i + 64])]
    else:
        pcm = [(mulaw if codec == "mulaw" else alaw)(b) for b in payload]
    pcm = resampled(pcm, 8000, 16000)
    data = struct.pack(f"<{len(pcm)}h", *pcm)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    rms = isqrt(sum(v * v for v in pcm) // len(pcm))
    return {
        "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "feature": f"{codec};rate=16000;samples={len(pcm)};peak={max(map(abs, pcm))};rms={rms};crossings={crossings};crc={zlib.crc32(data)}",
        "pcm_bytes": 44 + len(data), "pcm": data,
    }


TEXTS = [None, "", "a", "x" * 64, "é😀 " * 50, *(f"text {i} " * (i * 7 % 90) for i in range(60)), "q" * 20_000]


def test_digests_and_files(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, audio string").repartition(3)
    rows = {r.doc_id: r for r in media.audio_digests(df).collect()}
    files = {r.doc_id: r for r in media.audio_column(df).collect()}
    assert media.audio_column(df).columns == ["doc_id", "text", "audio", "audio_"] and media.audio_column(df.limit(0)).count() == 0
    for i, t in enumerate(TEXTS):
        want, row, file = scalar((t or "").encode()), rows[i].asDict(), files[i]["audio_"]
        data = want.pop("pcm")
        assert {k: row[k] for k in want} == want and files[i].audio == "kept" and files[i].text == t
        assert media.unwav(bytes(file.pcm)) == ("pcm", 16000, data) and row["pcm_sha256"] == hashlib.sha256(file.pcm).hexdigest()
        codec, _, back = media.unwav(bytes(file.media))
        assert back == bytes(file.payload) == (t or "").encode() + back[len((t or "").encode()) :] and want["feature"].startswith(codec)
        assert (row["media_bytes"], row["media_sha256"]) == (len(file.media), hashlib.sha256(file.media).hexdigest())
    assert len({r.feature.split(";")[0] for r in rows.values()}) == 3
