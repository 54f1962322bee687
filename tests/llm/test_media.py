"""Telephony media columns: exact round trips, known values, and decoding one sample at a time."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracewright.llm import telephony as t


def test_laws_have_their_known_values():
    assert [int(t.LAWS["mulaw"][x]) for x in (0x00, 0x80, 0xFF, 0x7F, 0xEF, 0x6F)] == [-32124, 32124, 0, 0, 132, -132]
    assert [int(t.LAWS["alaw"][x]) for x in (0x55, 0xD5, 0xAA, 0x2A, 0xC5)] == [-8, 8, 32256, -32256, 264]
    for law in t.LAWS.values():
        assert len(set(law.tolist())) >= 255


def one_by_one(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = t.STEPS[index]
            change = step >> 3
            if code & 1:
                change += step >> 2
            if code & 2:
                change += step >> 1
            if code & 4:
                change += step
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + t.ADJUST[code & 7]))
            out.append(sample)
    return out


def test_adpcm_blocks_decode_as_one_by_one():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (9, 4 + t.UNIT), dtype=np.uint8)
    blocks[0, 4:], blocks[1, 4:] = 0x77, 0xFF
    assert t.adpcm_samples(blocks).tolist() == [one_by_one(bytes(b)) for b in blocks]


def test_resampling_in_pieces_and_by_formula(monkeypatch):
    pcm = np.random.default_rng(5).integers(-32768, 32768, 1001).astype(np.int16)
    whole = np.concatenate(list(t.resampled(pcm)))
    monkeypatch.setattr(t, "PIECE", 64)
    assert np.array_equal(np.concatenate(list(t.resampled(pcm))), whole)
    assert t.TAPS.sum() == 32768 and t.TAPS.tolist() == t.TAPS[::-1].tolist()
    at = lambda i: int(pcm[min(len(pcm) - 1, max(0, i))])
    between = [max(-32768, min(32767, (sum(int(w) * at(i + k - 2) for k, w in enumerate(t.TAPS)) + 16384) >> 15)) for i in range(len(pcm))]
    assert whole[::2].tolist() == pcm.tolist() and whole[1::2].tolist() == between
    flat = np.full(50, 1234, np.int16)
    assert set(np.concatenate(list(t.resampled(flat))).tolist()) == {1234}
    tone = (20000 * np.sin(np.arange(400) / 5)).astype(np.int16)
    exact = 20000 * np.sin((np.arange(400) + 0.5) / 5)
    assert np.abs(np.concatenate(list(t.resampled(tone)))[1::2][5:-5] - exact[5:-5]).max() < 200


def test_files_that_are_none():
    good = t.wave(t.padded(b"abc"), "adpcm")
    assert t.unwave(good)[0] == "adpcm"
    for bad in (None, b"", b"RIFF", b"RIFF\0\0\0\0WAVE", good[:-1], b"X" + good[1:], good.replace(b"\x11\0\x01\0", b"\x11\0\x02\0", 1), good.replace(b"\x11\0\x01\0", b"\x01\0\x01\0", 1)):
        assert t.unwave(bad) is None
    assert t.unwave(good[:12] + b"LIST\x03\0\0\0abc\0" + good[12:]) == t.unwave(good)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 96, "日本" * 700, "long word " * 60000, "same", "same"]
    texts += ["".join(rng.choice("abc dé\n\0") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    return list(enumerate(texts)) + [(None, "no id"), (3, "a")]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_round_trip(spark, rows, codec):
    d = spark.createDataFrame([(i, x, b"clash", 1) for i, x in rows], "doc_id long, text string, payload binary, feature int")
    out = t.opened(t.stored(d, codec)).collect()
    payloads = sorted(t.padded((x or "").encode()) for _, x in rows)
    assert sorted(r["payload"] for r in out) == payloads
    for r in out:
        sound = t.LAWS[codec][np.frombuffer(r["payload"], np.uint8)] if codec in t.LAWS else np.concatenate([one_by_one(bytes(4) + r["payload"][k : k + 192]) for k in range(0, min(1920, len(r["payload"])), 192)])
        pcm = np.frombuffer(r["pcm"], "<i2")
        assert np.array_equal(pcm[::2][: len(sound)], sound[: len(pcm)])
        name, samples, peak, rms, changes, crc = r["feature"].split(":")
        assert (name, int(samples), int(crc, 16)) == (codec, len(pcm) // 2, zlib.crc32(r["pcm"]))
        x = pcm[::2].astype(float)
        assert int(peak) == np.abs(x).max() and int(rms) == int(np.sqrt((x * x).mean())) and int(changes) == np.count_nonzero(np.diff(pcm[::2] < 0))


def test_digests(spark, rows):
    d = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, media int")
    got = t.digests(d).collect()
    want = []
    for i, x in rows:
        raw = (x or "").encode()
        p = raw + b" " * (192 if not raw else -len(raw) % 192)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    media = {r["payload_sha256"]: (r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}
    assert len(media) == len({x for x in media.values()}) == len({r["payload_sha256"] for r in got})
    assert all((r["media_sha256"], r["media_bytes"], r["feature"]) == media[r["payload_sha256"]] for r in got)
    assert {r["feature"].split(":")[0] for r in got} == {"mulaw", "alaw", "adpcm"}
    assert t.digests(d.limit(0)).count() == 0
