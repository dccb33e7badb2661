"""Telephony audio in binary columns: G.711 expansion by table, IMA ADPCM by blocks, resampled 16-bit PCM.

A media value is a WAVE file with one fmt and one data chunk. Codecs: "mulaw" and "alaw" (8-bit codes, expanded through
a table of 256 entries built by rule) and "ima_adpcm" (blocks of a 4-byte header and 4-bit codes). ADPCM is sequential inside
a block only, so all blocks of a batch are decoded together, one numpy step per sample position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventara.llm.base import Scratch, map_values

#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}

#: IMA ADPCM step sizes and index moves.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876,
    963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)

#: Samples a second of the stored form and of the PCM made from it, bytes of an ADPCM block, and unit of the payload.
RATE, PCM_RATE, BLOCK, UNIT = 8000, 4000, 36, 576

#: Bytes decoded at once in a task.
CHUNK = 1 << 21


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent = code >> 4 & 7
    size = ((code & 15) << 4) + 8 + np.where(exponent > 0, 0x100, 0) << np.maximum(exponent - 1, 0)
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
#: Change of the predictor by step index and code, and next step index.
_CODES = np.arange(16)
CHANGES = ((STEPS[:, None] >> 3) + sum(np.where(_CODES & bit, STEPS[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2)))) * np.where(_CODES & 8, -1, 1)
CHANGES = CHANGES.astype(np.int32)
NEXT = np.clip(np.arange(89)[:, None] + MOVES, 0, 88).astype(np.int32)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) uint8 to (n, samples) int16: the header's sample, then two samples a byte, low half first."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    changes, following = CHANGES.ravel(), NEXT.ravel()
    for k in range(width - 4):
        for half, code in ((1, codes[k] & 15), (2, codes[k] >> 4)):
            at = index << 4 | code
            value = np.clip(value + changes[at], -32768, 32767)
            index = following[at]
            out[2 * k + half] = value
    return out.T


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == to or not len(samples):
        return samples.astype("<i2")
    x = samples.astype(np.int64)
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    return ((x[left] * (to - part) + x[np.minimum(left + 1, len(x) - 1)] * part) // to).astype("<i2")


def wrap(payload: bytes, codec: str = "mulaw", rate: int = RATE, block: int = 1) -> bytes:
    """A WAVE file around the codes."""
    bits = 4 if codec == "ima_adpcm" else 8
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * bits // 8, block, bits)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block bytes, codes) of a WAVE file; ValueError if it is none of these."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            codec = next((k for k, v in TAGS.items() if v == fmt[0]), None)
            if codec is None or at + 8 + size > len(media):
                break
            return codec, fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no usable fmt and data chunk")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """(samples int16, rate) of one media value; an incomplete last ADPCM block is filled with zero codes."""
    codec, rate, block, codes = unwrap(media)
    raw = np.frombuffer(codes, np.uint8)
    if codec == "ima_adpcm":
        raw = np.concatenate([raw, np.zeros(-len(raw) % block, np.uint8)])
        return adpcm_blocks(raw.reshape(-1, block)).ravel(), rate
    return (MULAW if codec == "mulaw" else ALAW)[raw], rate


def to_pcm(df: DataFrame, media: str = "media", out: str = "pcm", rate: int = PCM_RATE) -> DataFrame:
    """Adds the binary column `out`: 16-bit little-endian PCM at the given rate. Null or unreadable media give null."""

    @F.pandas_udf("binary")
    def convert(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                return None if value is None else resample(*decode(bytes(value)), rate).tobytes()
            except (ValueError, struct.error):
                return None

        return values.map(one)

    return df.withColumn(out, convert(df[media]))


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled with 255 to a positive multiple of UNIT. UTF-8 has no byte 255, so rstrip undoes it."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def store(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, media, pcm): the payload of every text (null: empty) as mu-law codes of a WAVE file, and its samples as 16-bit PCM at PCM_RATE.

    Repeated rows stay.
    """

    def make(texts: list) -> list:
        medias = [wrap(payload(t)) for t in texts]
        return [medias, [resample(*decode(m), PCM_RATE).astype("<i2").tobytes() for m in medias]]

    return map_values(df, [id_column], text, [("media", "binary"), ("pcm", "binary")], make)


def _chunks(values: list[dict]) -> Iterator[list[dict]]:
    """Consecutive values of about CHUNK bytes of media."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value["media"])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _described(held: list[dict]) -> Iterator[tuple]:
    codes = [unwrap(x["media"])[3] for x in held]
    raw = np.frombuffer(b"".join(codes), np.uint8)
    sums = np.abs(adpcm_blocks(raw.reshape(-1, BLOCK)).astype(np.int32)).sum(axis=1, dtype=np.int64)
    starts = np.cumsum([0, *(len(c) for c in codes)])
    adpcm = np.add.reduceat(sums, starts[:-1] // BLOCK)
    for k, (x, code) in enumerate(zip(held, codes, strict=True)):
        media, pcm = x["media"], zlib.crc32(x["pcm"])
        own = raw[starts[k] : starts[k + 1]]
        loud, other = MULAW[own], ALAW[own]
        energy, turns = int(np.square(loud, dtype=np.int64).sum()), int(np.count_nonzero((loud[1:] < 0) != (loud[:-1] < 0)))
        feature = f"mulaw={energy},{turns};alaw={int(np.square(other, dtype=np.int64).sum())};adpcm={int(adpcm[k])};pcm={pcm:08x}"
        yield len(code.rstrip(b"\xff")), len(code), hashlib.sha256(code).hexdigest(), zlib.crc32(code[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def features(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: sizes and digests of payload and media, and a feature text.

    The feature has, in whole numbers, energy and sign changes of the mu-law samples, energy of the same codes read as A-law,
    the sum of absolute samples of the codes read as IMA ADPCM blocks, and the CRC-32 of the stored PCM.
    """
    fields = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    both = stored.select(stored[id_column], F.struct("media", "pcm").alias("held"))
    return map_values(both, [id_column], "held", fields, lambda values: list(zip(*(row for part in _chunks(values) for row in _described(part)), strict=True)))


def stored_features(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the table of media and PCM to the shared folder, read it back, and describe what was read; then the table goes."""
    scratch = Scratch(df.sparkSession, "media")
    result = scratch.write(features(scratch.write(store(df, id_column, text), "media"), id_column), "result")
    scratch.drop("media")
    return result
