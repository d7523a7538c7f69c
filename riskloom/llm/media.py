"""Media columns: telephony audio (operator 5).

Bytes are kept as WAV files of the three telephony formats, and read back from
them: mu-law and A-law (one byte a sample) and IMA ADPCM (blocks of 64 bytes).
The companded formats are expanded by 256-entry lookup tables made from their
rule; ADPCM is decoded with numpy across the blocks of many texts, one step for
all blocks at a time.  Decoded sound is resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import free_name

UNIT = 64
RATE = 8000
#: Fixed values of the WAV container: format tags.
TAGS = {"mulaw": 7, "alaw": 6, "ima": 17, "pcm": 1}
CODECS = ("mulaw", "alaw", "ima")
#: Bytes of texts whose blocks are decoded together, but for a single longer text.
SLICE = 1 << 20
#: Samples in a mono IMA block of 64 bytes: one in the header, two in each further byte.
IMA_SAMPLES = 1 + 2 * (UNIT - 4)
#: Fixed values of IMA ADPCM: change of the step index for each code without its sign.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, seg = (code & 15) << 4, code >> 4 & 7
    size = np.where(seg == 0, low + 8, (low + 264) << np.maximum(seg - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _ima_steps() -> np.ndarray:
    # Fixed values of IMA ADPCM: step sizes, in order.
    steps = [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
        5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
        27086, 29794, 32767,
    ]
    return np.array(steps, np.int32)


MULAW, ALAW, STEPS = _mulaw_table(), _alaw_table(), _ima_steps()


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the value and next step index, by step index * 16 + code."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = step >> 3
    for bit, shift in ((4, 0), (2, 1), (1, 2)):
        size = size + np.where(code & bit, step >> shift, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).reshape(-1).astype(np.int32), (16 * index).reshape(-1).astype(np.int32)


CHANGE, NEXT = _ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples.  A step index beyond 88 counts as 88."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = 16 * np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((IMA_SAMPLES, len(blocks)), np.int16)
    out[0] = value = head
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(IMA_SAMPLES - 1):
        at = at + (codes[i >> 1] >> 4 * (i & 1) & 15)
        value = np.clip(value + CHANGE[at], -32768, 32767)
        at = NEXT[at]
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def wav(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds *data* unchanged."""
    align, bits = {"mulaw": (1, 8), "alaw": (1, 8), "ima": (UNIT, 4), "pcm": (2, 16)}[codec]
    bytes_s = rate * UNIT // IMA_SAMPLES if codec == "ima" else rate * align
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, bytes_s, align, bits)
    if codec == "ima":
        fmt += struct.pack("<HH", 2, IMA_SAMPLES)
    elif codec != "pcm":
        fmt += struct.pack("<H", 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if codec != "pcm":
        n = len(data) // UNIT * IMA_SAMPLES if codec == "ima" else len(data)
        body += b"fact" + struct.pack("<II", 4, n & 0xFFFFFFFF)
    body += b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body


def unwav(file: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a WAV file; ValueError where it is none."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(file):
                raise ValueError("cut short")
            tag, channels, rate = struct.unpack_from("<HHI", file, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
            if codec is None or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels")
        elif name == b"data":
            if codec is None:
                raise ValueError("data before fmt")
            return codec, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def decode(codec: str, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if codec == "mulaw":
        return MULAW[raw]
    if codec == "alaw":
        return ALAW[raw]
    if codec == "ima":
        return decode_ima(raw[: len(raw) // UNIT * UNIT].reshape(-1, UNIT)).reshape(-1)
    return raw[: len(raw) // 2 * 2].view("<i2")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on the exact rational grid, in integers: samples
    rounded down, the last one held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if to % rate == 0:  # the same, with one rest for each of the samples between two
        times = to // rate
        a = pcm.astype(np.int32)
        ahead = np.append(a[1:], a[-1]) - a
        out = np.empty((len(a), times), np.int16)
        for k in range(times):
            out[:, k] = a + ahead * k // times
        return out.reshape(-1)
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    i, rest = at // to, at % to
    a, b = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)]
    return (a + (b - a) * rest // to).astype(np.int16)


def features(pcm: np.ndarray, rate: int) -> str:
    """Length, level and shape of the sound, all from integers."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt(int(np.dot(x, x)) / max(len(x), 1)))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"rate={rate};samples={len(x)};peak={int(np.abs(x).max(initial=0))};rms={rms};crossings={crossings};crc={zlib.crc32(pcm)}"


def to_payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def store(payload: bytes) -> bytes:
    """The WAV file of a payload; its checksum picks the codec, so equal
    payloads give equal files and all three formats are in use."""
    return wav(payload, CODECS[zlib.crc32(payload) % 3])


class Sound(NamedTuple):
    """One text as audio: its size, the stored file, what is read back from it,
    and the decoded sound as a 16-bit PCM file with its features."""

    n_bytes: int
    media: bytes
    payload: bytes
    feature: str
    pcm: bytes


def sounds(column: pa.Array, to_rate: int):
    """(first row, sounds) for slices of a text column; null counts as empty.
    All ADPCM blocks of a slice are decoded as one array."""
    raw, offsets = K.string_bytes(column)
    for i, j in K.blocks(offsets, SLICE):
        texts = [raw[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
        media = [store(to_payload(t)) for t in texts]
        read = [unwav(m) for m in media]
        data = b"".join(d for codec, _, d in read if codec == "ima")
        decoded, at = decode_ima(np.frombuffer(data, np.uint8).reshape(-1, UNIT)), 0
        out = []
        for t, m, (codec, rate, back) in zip(texts, media, read):
            if codec == "ima":
                pcm = decoded[at : at + len(back) // UNIT].reshape(-1)
                at += len(back) // UNIT
            else:
                pcm = decode(codec, back)
            pcm = resample(pcm, rate, to_rate)
            out.append(Sound(len(t), m, back, f"{codec};{features(pcm, to_rate)}", wav(pcm.tobytes(), "pcm", to_rate)))
        yield i, out


def audio_column(df: DataFrame, text: str = "text", to_rate: int = 16000, out: str = "audio") -> DataFrame:
    """All columns of *df* plus *out*: a struct of n_bytes, the stored file
    (media), the payload read back, feature, and the resampled sound as a 16-bit
    PCM file.  Null and empty texts become 64 zero bytes.  Rows stay where they
    lie, so that neither skew nor repeated rows matter; an empty table gives an
    empty one.  If *df* has a column *out*, the new one gets underscores."""
    place, out = df.columns.index(text), free_name(out, df.columns)
    kind = pa.struct([("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string()), ("pcm", pa.binary())])
    schema = T.StructType(list(df.schema.fields)).add(out, T.StructType().add("n_bytes", T.LongType()).add("media", T.BinaryType()).add("payload", T.BinaryType()).add("feature", T.StringType()).add("pcm", T.BinaryType()))

    def run(batches):
        for batch in batches:
            for i, found in sounds(batch.column(place), to_rate):
                rows = batch.slice(i, len(found))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([s._asdict() for s in found], kind)], [*rows.schema.names, out])

    return df.mapInArrow(run, schema)


def audio_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", to_rate: int = 16000) -> DataFrame:
    """The digest columns of the stored audio of every text, and of the 16-bit
    PCM file of its resampled sound.  Null and empty texts become 64 zero bytes;
    repeated rows give repeated results.  An empty table gives an empty result;
    other columns of *df*, whatever their names, are neither read nor returned."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_bytes bigint, pcm_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in schema.split(", ")[1:]]

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def run(batches):
        for batch in batches:
            for i, found in sounds(batch.column(1), to_rate):
                rows = [(s.n_bytes, len(s.payload), sha(s.payload), zlib.crc32(s.payload[-UNIT:]), len(s.media), sha(s.media), s.feature, len(s.pcm), sha(s.pcm)) for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(found)), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
