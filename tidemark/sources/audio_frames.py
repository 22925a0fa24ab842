"""Binary audio: self-describing frames and WAV files, decoded and encoded in Arrow batches.

A frame is: two magic bytes, version, number of fields; per field key, kind, length (two bytes)
and value; the payload; a CRC-32 of all before it. Numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the frame format.
MAGIC = b"SA"
VERSION = 1
SENT_AT, CHUNK_ID, STAGE_DEPTH = 1, 2, 3
KIND_UINT, KIND_FLOAT, KIND_TEXT = 0, 1, 2

DECODED = "version int, chunk_id string, sent_at double, stage_depth long, audio binary, error string"


def encode_frame(chunk_id: str, audio: bytes, sent_at: float | None = None, stage_depth: int | None = None) -> bytes:
    fields = [(CHUNK_ID, KIND_TEXT, chunk_id.encode())]
    if sent_at is not None:
        fields.insert(0, (SENT_AT, KIND_FLOAT, struct.pack("<d", sent_at)))
    if stage_depth is not None:
        fields.append((STAGE_DEPTH, KIND_UINT, stage_depth.to_bytes(max(1, (stage_depth.bit_length() + 7) // 8), "little")))
    body = b"".join([MAGIC, bytes([VERSION, len(fields)]), *(struct.pack("<BBH", k, t, len(v)) + v for k, t, v in fields), audio])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(data: bytes) -> dict:
    """Fields of a frame; ``error`` tells what is wrong with one that is none. Unknown fields are passed over."""
    out = {"version": None, "chunk_id": None, "sent_at": None, "stage_depth": None, "audio": None, "error": None}
    if len(data) < 8 or data[:2] != MAGIC:
        return out | {"error": "not a frame"}
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        return out | {"error": "checksum"}
    out["version"], at = data[2], 4
    for _ in range(data[3]):
        if at + 4 > len(data) - 4:
            return out | {"error": "truncated"}
        key, _, size = struct.unpack_from("<BBH", data, at)
        value = data[at + 4 : at + 4 + size]
        at += 4 + size
        if at > len(data) - 4:
            return out | {"error": "truncated"}
        if key == SENT_AT and size == 8:
            out["sent_at"] = struct.unpack("<d", value)[0]
        elif key == CHUNK_ID:
            out["chunk_id"] = value.decode("utf-8", "replace")
        elif key == STAGE_DEPTH and size <= 8:
            out["stage_depth"] = int.from_bytes(value, "little")
    return out | {"audio": data[at:-4]}


#: Kinds of samples in a WAV file.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decoded_frames(df: DataFrame, column: str) -> DataFrame:
    """The frame's fields beside every column of ``df``."""

    @F.pandas_udf(DECODED)
    def decode(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_frame(d or b"") for d in data], columns=[c.split()[0] for c in DECODED.split(", ")])

    return df.withColumn("frame", decode(column))


def crc_of_frame(frame: Column) -> Column:
    """Checksum of all but the last four bytes, native."""
    return F.crc32(F.substr(frame, F.lit(1), F.length(frame) - 4))


def _wav_parts(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(kind, bits, rate, channels, body) of a RIFF/WAVE file; an extensible format is the kind it names."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, bits, rate, channels, samples = 12, 0, 0, 0, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack_from("<H", body, 24)[0]
        elif name == b"data":
            samples = body
        at += 8 + size + size % 2
    if samples is None or not rate or not channels:
        raise ValueError("no samples")
    return kind, bits, rate, channels, samples


def decode_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, 16-bit samples) of a RIFF/WAVE file in PCM16."""
    kind, bits, rate, channels, body = _wav_parts(data)
    if (kind, bits) != (PCM, 16):
        raise ValueError("only PCM16")
    return rate, channels, np.frombuffer(body[: len(body) // 2 * 2], "<i2")


def decode_samples(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples by channel in -1..1) of a RIFF/WAVE file: whole numbers of 8, 16, 24 or 32 bits, or floats of 32 or 64."""
    kind, bits, rate, channels, body = _wav_parts(data)
    width = bits // 8
    if (kind, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise ValueError(f"no format {kind} of {bits} bits")
    raw = np.frombuffer(body[: len(body) // (width * channels) * width * channels], np.uint8)
    if kind == FLOAT:
        x = raw.view(f"<f{width}").astype(np.float64)
    elif bits == 8:  # the only one without a sign
        x = (raw.astype(np.float64) - 128) / 128
    else:  # the bytes are the high ones of 32 bits
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.view("<i4").ravel() / 2.0**31
    return rate, x.reshape(-1, channels)


def encode_wav(samples: np.ndarray, rate: int, channels: int) -> bytes:
    body = samples.astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"".join([b"RIFF", struct.pack("<I", 36 + len(body)), b"WAVEfmt ", struct.pack("<I", 16), head, b"data", struct.pack("<I", len(body)), body])


def wav_chunks(files: DataFrame, milliseconds: int) -> DataFrame:
    """(path, chunk, rate, channels, pcm) of binary files (path, content): pieces of equal length, the last one shorter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                rate, channels, samples = decode_wav(content)
                step = max(1, rate * milliseconds // 1000) * channels
                rows += [(path, k, rate, channels, samples[a : a + step].tolist()) for k, a in enumerate(range(0, len(samples), step))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "rate", "channels", "pcm"])

    return files.select("path", "content").mapInPandas(run, "path string, chunk int, rate int, channels int, pcm array<short>")
