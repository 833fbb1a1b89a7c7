"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, expanded to resampled PCM.

Method. mu-law and A-law codes are expanded by 256-entry lookup tables that are built from their rules.
ADPCM is sequential inside a block, so blocks are decoded side by side: step t decodes the t-th nibble
of every block of the batch at once in numpy. PCM is resampled in integer arithmetic and stored as 16-bit WAV.

``store`` writes byte payloads losslessly as a codec's units and ``expand`` reads them back. Nulls: a null
payload is empty. Payloads are padded with zero bytes to a positive multiple of ``BLOCK``. Rows are
independent, so repeated ids, ties and empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.batches import OWN, blocks, strings, table, with_id

RATE, TARGET_RATE, BLOCK = 8000, 16000, 64
#: WAV format codes, and the step sizes and index changes of IMA ADPCM: fixed values of the formats.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 17}
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = ((code & 15) * 8 + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent = code >> 4 & 7
    size = np.where(exponent == 0, (code & 15) * 16 + 8, (code & 15) * 16 + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def decode_ima(payload: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """PCM of mono ADPCM blocks: a row a block, the header's sample and two samples a byte."""
    rows = payload.reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(rows)), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(rows[:, 4:].T)
    for t in range(2 * (block - 4)):
        nibble = (columns[t // 2] >> (4 * (t % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[nibble], 0, 88)
        out[t + 1] = value
    return np.ascontiguousarray(out.T)


def to_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file around a codec's bytes."""
    if codec == "pcm":
        fmt, units = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16), len(payload) // 2
    elif codec == "ima":
        each = 1 + 2 * (BLOCK - 4)
        fmt, units = struct.pack("<HHIIHHHH", 17, 1, rate, rate * BLOCK // each, BLOCK, 4, 2, each), len(payload) // BLOCK * each
    else:
        fmt, units = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    body = b"".join([b"WAVEfmt ", struct.pack("<I", len(fmt)), fmt, b"fact", struct.pack("<II", 4, units), b"data", struct.pack("<I", len(payload)), payload])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media) -> tuple[str, int, memoryview]:
    """Codec, rate and the data chunk's bytes."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("no WAV")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", view, at + 8)
            codec = next(k for k, v in FORMATS.items() if v == code)
        elif kind == b"data":
            return codec, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(codec: str, payload) -> np.ndarray:
    data = np.frombuffer(payload, np.uint8)
    if codec == "pcm":
        return data.view("<i2")
    return decode_ima(data).ravel() if codec == "ima" else TABLES[codec][data]


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation at exact rational positions; the last sample is held."""
    if rate == target or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * target // rate, dtype=np.int64) * rate
    left, part = at // target, at % target
    right = np.minimum(left + 1, len(pcm) - 1)
    low = pcm[left].astype(np.int64)
    return (low + (pcm[right] - low) * part // target).astype(np.int16)


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK or (0 if payload else BLOCK))


def codec_of(payload: bytes) -> str:
    """The codec a payload is stored with, by its content alone: equal payloads, equal media."""
    return ("mulaw", "alaw", "ima")[zlib.crc32(payload) % 3]


def store(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", codec: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, media``: every payload as a WAV file of the codec (None: by content)."""
    schema = pa.schema([("doc_id", OWN), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches):
        for batch in blocks(batches, "data"):
            data, at = strings(batch.column("data"))
            raw, at = data.tobytes(), at.tolist()
            padded = [pad(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield table(schema, batch.column("id"), np.diff(at), pa.array([to_wav(p, codec or codec_of(p)) for p in padded], pa.binary()))

    return docs.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInArrow(write, with_id(docs, id_col, "n_bytes bigint, media binary"))


def expand(media: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """``doc_id, pcm``: the stored media decoded, resampled and stored as 16-bit WAV."""
    schema = pa.schema([("doc_id", OWN), ("pcm", pa.binary())])

    def convert(batches):
        for batch in blocks(batches, "media", 1 << 20):
            out = []
            for one in batch.column("media").to_pylist():
                codec, own, payload = from_wav(one)
                out.append(to_wav(resample(decode(codec, payload), own, rate).tobytes(), "pcm", rate))
            yield table(schema, batch.column("doc_id"), pa.array(out, pa.binary()))

    return media.select("doc_id", "media").mapInArrow(convert, with_id(media, "doc_id", "pcm binary"))


def features(pcm: np.ndarray, rate: int, target: int) -> str:
    """Peak, rounded RMS, sign changes and the checksum of the resampled PCM."""
    wide = pcm.astype(np.int32)
    power = int(np.dot(pcm.astype(np.float64), pcm)) // max(len(pcm), 1)  # sums of integers below 2**53 are exact
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"peak={int(np.abs(wide).max(initial=0))};power={power};turns={turns};pcm={zlib.crc32(resample(pcm, rate, target).tobytes()):08x}"


DIGEST = pa.schema([("doc_id", OWN), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest(media: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """What was read back from the stored media: sizes, checksums and features of the decoded sound."""

    def read(batches):
        for batch in blocks(batches, "media"):
            files = [from_wav(x.as_buffer()) for x in batch.column("media")]
            ima = [i for i, f in enumerate(files) if f[0] == "ima"]
            decoded: dict[int, np.ndarray] = {}
            if ima:  # blocks of all rows side by side
                pcm = decode_ima(np.frombuffer(b"".join([files[i][2] for i in ima]), np.uint8))
                ends = np.cumsum([len(files[i][2]) // BLOCK for i in ima])
                decoded = {i: p.ravel() for i, p in zip(ima, np.split(pcm, ends[:-1]), strict=True)}
            rows = []
            for i, (codec, own, payload) in enumerate(files):
                sound = decoded[i] if i in decoded else decode(codec, payload)
                whole = batch.column("media")[i].as_buffer()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(whole), hashlib.sha256(whole).hexdigest(), features(sound, own, rate)))
            yield table(DIGEST, batch.column("doc_id"), batch.column("n_bytes"), *zip(*rows, strict=True))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, with_id(media, "doc_id", "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"))
