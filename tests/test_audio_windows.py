"""Rolling windows from summaries, buffers that give back, decoding and resampling."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from tidemark.operators import rolling
from tidemark.sources import channels
from tidemark.sources.audio_frames import decode_samples

SCHEMA = "k string, n int, samples array<double>"


def series(rng, chunks, most):
    return [(j, [rng.choice([0.0, 0.2, -0.5, 0.995, 1.0, -0.99]) for _ in range(rng.randrange(most))]) for j in range(chunks)]


def plain(x, block, window):
    """Snapshots over the samples themselves."""
    db = lambda v: max(-120.0, 20 * np.log10(v)) if v > 0 else -120.0
    rms = lambda v: float(np.sqrt(np.mean(np.square(v))))
    out = {}
    for b in range(-(-len(x) // block)):
        if (b + 1) * block > len(x) and b >= window:
            continue
        w = np.array(x[max(0, b + 1 - window) * block : (b + 1) * block])
        run = hit = 0
        for v in [*(np.abs(w) >= 0.99), False]:
            run, hit = (run + 1, hit) if v else (0, hit + (run if run >= 2 else 0))
        levels = [db(rms(w[k : k + block])) for k in range(0, len(w) - block + 1, block)]
        out[b] = (len(w), db(rms(w)), db(np.abs(w).max()), hit / len(w), db(rms(w)) <= db(0.3), float(np.percentile(levels, 10)) if len(levels) > 1 else db(rms(w)))
    return out


@pytest.mark.parametrize(("block", "window"), [(7, 4), (1, 3), (50, 2)])
def test_windows_are_merged_summaries(spark, block, window):
    rng = random.Random(block)
    all_ = {k: series(rng, 30, 12) for k in "ab"} | {"short": [(0, [0.1, 1.0])], "none": [(0, []), (1, [])], "rail": [(0, [1.0] * 40), (1, [-1.0] * 33)]}
    df = spark.createDataFrame([(k, n, s) for k, v in all_.items() for n, s in v], SCHEMA).repartition(4)
    got = {k: {} for k in all_}
    for r in rolling.meter(df, ["k"], "n", "samples", block, window, silence=0.3).collect():
        got[r["k"]][r["block"]] = (r["n"], r["rms_db"], r["peak_db"], r["clipped"], r["silent"], r["floor_db"])
    for k, v in all_.items():
        want = plain([x for _, s in v for x in s], block, window)
        assert set(got[k]) == set(want)
        for b in want:
            assert got[k][b] == pytest.approx(want[b], abs=1e-9)


@pytest.mark.parametrize("capacity", [0, 1, 37, 10_000])
def test_kept_and_overflow_are_the_input(spark, capacity):
    rng = random.Random(capacity)
    rows = [(k, n, s) for k in "ab" for n, s in series(rng, 20, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for kept_first, op in ((True, rolling.filled), (False, rolling.rolled)):
        for k in "ab":
            got = op(df, ["k"], "n", "samples", capacity).where(f"k = '{k}'").orderBy("n").collect()
            whole = [x for _, _, s in (r for r in rows if r[0] == k) for x in s]
            kept = [x for r in got for x in r["kept"]]
            assert kept == (whole[:capacity] if kept_first else whole[max(0, len(whole) - capacity) :])
            for r in got:
                assert (r["kept"] + r["overflow"] if kept_first else r["overflow"] + r["kept"]) == r["samples"]


def wav(kind, bits, rate, chans, body, extensible=False):
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, chans, rate, rate * chans * bits // 8, chans * bits // 8, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, kind) + b"\0" * 14
    parts = b"fmt " + struct.pack("<I", len(head)) + head + b"LIST" + struct.pack("<I", 3) + b"odd\0" + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


@pytest.mark.parametrize("extensible", [False, True])
def test_formats(extensible):
    x = np.array([0.0, 0.5, -0.5, -1.0, 0.25, 0.75])
    bodies = {
        (1, 8): (x * 128 + 128).astype(np.uint8).tobytes(), (1, 16): (x * 32768).astype("<i2").tobytes(), (1, 24): b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x),
        (1, 32): (x * 2.0**31).astype("<i4").tobytes(), (3, 32): x.astype("<f4").tobytes(), (3, 64): x.astype("<f8").tobytes(),
    }
    for (kind, bits), body in bodies.items():
        rate, got = decode_samples(wav(kind, bits, 8000, 2, body + b"\1", extensible))
        assert rate == 8000 and got.tolist() == x.reshape(-1, 2).tolist()
    for kind, bits in ((1, 12), (7, 8), (3, 16)):
        with pytest.raises(ValueError, match="no format"):
            decode_samples(wav(kind, bits, 8000, 1, b"\0" * 8, extensible))


def tone(hertz, rate, n):
    return np.sin(2 * np.pi * hertz * np.arange(n) / rate)


@pytest.mark.parametrize(("rate", "target"), [(48_000, 16_000), (44_100, 16_000), (22_050, 8_000), (8_000, 16_000), (16_000, 44_100)])
def test_what_the_new_rate_cannot_carry_vanishes(rate, target):
    inside, n = 0.35 * min(rate, target), rate
    got = channels.resampled(tone(inside, rate, n), rate, target)
    assert len(got) == -(-n * target // rate)
    mid = slice(len(got) // 4, 3 * len(got) // 4)
    assert np.abs(got - tone(inside, target, len(got)))[mid].max() < 1e-3
    if target < rate:
        gone = channels.resampled(tone(0.5 * target * 1.15, rate, n), rate, target)
        assert np.abs(gone[mid]).max() < 1e-3
    assert len(channels.resampled(np.zeros(0), rate, target)) == 0 and channels.resampled(np.ones(1), rate, target).shape == (-(-target // rate),)
