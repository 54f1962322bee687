"""Media columns of telephony audio: mu-law, A-law and block ADPCM kept as WAVE files, opened as PCM.

`stored` puts bytes into a media column without loss, as the samples of a WAVE file: one byte a mu-law or
A-law sample, or half a byte an IMA ADPCM code in blocks of UNIT bytes, each behind its own four bytes of
start state, so that blocks decode apart from each other. `opened` reads the files back: samples of the two laws
come from tables of 256 values; ADPCM blocks of all rows of a batch are decoded side by side, one step of
all blocks at a time; PCM of 8 kHz is resampled to 16 kHz by a fixed windowed sinc.

Defined results: a null text counts as empty; the payload is the text's UTF-8, padded with spaces to a
positive multiple of UNIT; equal payloads give equal media; a media value that is null, no WAVE file, of
another codec or cut short opens as nulls; very long rows are decoded and resampled in pieces; empty tables
give empty tables; repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import materialize, table

RATE, UNIT = 8000, 192
#: Samples that are resampled at a time, and ADPCM blocks decoded side by side.
PIECE, BLOCKS = 1 << 18, 4096

# fixed values: format tags of RIFF WAVE
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
# fixed values: steps and index changes of IMA ADPCM
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
ADJUST = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    high, low = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(high > 0, low + 256 << np.maximum(high - 1, 0), low)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """(change of the sample, next index) by index * 16 + code."""
    step = np.array(STEPS)[:, None]
    code = np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(ADJUST)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


LAWS = {"mulaw": mulaw_table(), "alaw": alaw_table()}
CHANGE, AFTER = adpcm_tables()


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (a row of bytes each): the start sample, then one for each code, low half first."""
    n, width = blocks.shape
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel()
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample, index = head.astype(np.int32), np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = head
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (width - 4)):
        at = index + (codes[i // 2] >> 4 if i % 2 else codes[i // 2] & 15)
        sample = np.clip(sample + CHANGE[at], -32768, 32767)
        index = AFTER[at]
        out[i + 1] = sample
    return out.T


def tap_weights() -> np.ndarray:
    """Lanczos weights of the six samples around the middle between two, in 1/32768, of sum 32768."""
    at = np.arange(6) - 2.5
    w = np.sinc(at) * np.sinc(at / 3)
    w = np.round(w / w.sum() * 32768).astype(np.int64)
    w[2:4] += (32768 - w.sum()) // 2
    return w


TAPS = tap_weights()


def resampled(pcm: np.ndarray):
    """Pieces of PCM at twice the rate: each sample, then the one between it and the next. The ends repeat."""
    n = len(pcm)
    for start in range(0, n, PIECE):
        end = min(n, start + PIECE)
        x = pcm[np.clip(np.arange(start - 2, end + 3), 0, n - 1)].astype(np.int64)
        between = sum(int(w) * x[k : k + end - start] for k, w in enumerate(TAPS))
        out = np.empty(2 * (end - start), np.int16)
        out[::2] = pcm[start:end]
        out[1::2] = np.clip(between + 16384 >> 15, -32768, 32767)
        yield out


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file whose samples are the payload's bytes."""
    if codec == "adpcm":
        body = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)
        body[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, per_block, align, samples = body.tobytes(), 1 + 2 * UNIT, 4 + UNIT, (1 + 2 * UNIT) * len(body)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * align // per_block, align, 4, 2, per_block)
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwave(media: bytes | None) -> tuple[str, bytes] | None:
    """(codec, data) of a WAVE file of one channel; None where it is not one that `wave` can write."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, width = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + size]
        if len(body) < size:
            return None
        if name == b"fmt " and size >= 16:
            tag, channels, _, _, width, _ = struct.unpack("<HHIIHH", body[:16])
            codec = next((c for c, t in TAGS.items() if t == tag and channels == 1), None)
        elif name == b"data":
            right = codec and (width == 1 if codec in LAWS else width == 4 + UNIT and size % width == 0)
            return (codec, body) if right else None
        at += 8 + size + (size & 1)
    return None


def stored(docs: DataFrame, codec: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, codec, media: each whole text as a WAVE file. Without a codec, the payload's crc32
    deals the three."""
    ship(docs.sparkSession)
    names = sorted(TAGS, key=TAGS.get)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            payloads = [padded(t) for t in texts]
            codecs = [codec or names[zlib.crc32(p) % len(names)] for p in payloads]
            media = [wave(p, c) for p, c in zip(payloads, codecs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(codecs, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    rows = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, codec string, media binary")


def pcm_of(files: list[tuple[str, bytes] | None]) -> list[np.ndarray | None]:
    """PCM of each file; ADPCM blocks of all files are decoded together, BLOCKS at a time."""
    own = [i for i, x in enumerate(files) if x and x[0] == "adpcm"]
    out = [LAWS[x[0]][np.frombuffer(x[1], np.uint8)] if x and x[0] in LAWS else None for x in files]
    if own:
        blocks = np.frombuffer(b"".join(files[i][1] for i in own), np.uint8).reshape(-1, 4 + UNIT)
        samples = np.concatenate([adpcm_samples(blocks[k : k + BLOCKS]) for k in range(0, max(1, len(blocks)), BLOCKS)]) if len(blocks) else np.zeros((0, 1 + 2 * UNIT), np.int16)
        ends = np.cumsum([len(files[i][1]) // (4 + UNIT) for i in own])
        for i, part in zip(own, np.split(samples, ends[:-1]), strict=True):
            out[i] = part.ravel()
    return out


def payload_of(file: tuple[str, bytes]) -> bytes:
    codec, data = file
    return data if codec in LAWS else np.frombuffer(data, np.uint8).reshape(-1, 4 + UNIT)[:, 4:].tobytes()


def features(codec: str, pcm: np.ndarray) -> tuple[str, int]:
    """(codec:samples:peak:root mean square:sign changes, crc32 of the resampled PCM)."""
    peak = power = changes = crc = 0
    for start in range(0, len(pcm), PIECE):
        x = pcm[start : start + PIECE].astype(np.int64)
        peak, power = max(peak, int(np.abs(x).max())), power + int(x @ x)
        negative = pcm[max(0, start - 1) : start + PIECE] < 0
        changes += int(np.count_nonzero(negative[1:] != negative[:-1]))
    for piece in resampled(pcm):
        crc = zlib.crc32(piece.tobytes(), crc)
    return f"{codec}:{len(pcm)}:{peak}:{math.isqrt(power // max(1, len(pcm)))}:{changes}", crc


def opened(files: DataFrame, pcm: bool = True) -> DataFrame:
    """files (with a column media) + payload, feature and, if asked for, pcm: little-endian 16-bit samples
    at 16 kHz. The feature ends with the crc32 of that PCM, so that it is made in either case."""
    ship(files.sparkSession)
    kept = [f for f in files.schema if f.name not in ("payload", "feature", "pcm")]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [unwave(m) for m in batch.column("media").to_pylist()]
            sound = pcm_of(found)
            told = [features(x[0], p) if x else None for x, p in zip(found, sound, strict=True)]
            columns = {f.name: batch.column(f.name) for f in kept}
            columns["payload"] = pa.array([payload_of(x) if x else None for x in found], pa.binary())
            columns["feature"] = pa.array([f"{x[0]}:{x[1]:08x}" if x else None for x in told], pa.string())
            if pcm:
                columns["pcm"] = pa.array([b"".join(x.astype("<i2").tobytes() for x in resampled(p)) if p is not None else None for p in sound], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    spec = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["payload binary", "feature string"] + ["pcm binary"] * pcm
    return files.select(*(f.name for f in kept)).mapInArrow(work, ", ".join(spec))


def digests(docs: DataFrame) -> DataFrame:
    """A row a document: sizes and digests of what was stored and of what was read back."""
    files = opened(materialize(stored(docs), "telephony", compression="zstd"), pcm=False)
    tail: Column = F.substring("payload", -16, 16)
    return files.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
