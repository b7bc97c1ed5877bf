"""Ogg: checksum against the definition, exact round trips, damage found."""

import hashlib
import random
import zlib

import pytest

from supplymesh.llm import ogg


def test_checksum():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for data in (b"", b"a", b"OggS and more", bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def test_round_trips_and_times():
    r = random.Random(1)
    for n in (0, 1, 254, 255, 256, 510, 6000, 12000, 12001, 200_000):
        for packet, streams, segments in ((255, 2, 4), (510, 1, 255), (6000, 3, 7), (17_000, 2, 64)):
            s = r.randbytes(n)
            audio = ogg.read(ogg.write(s, streams=streams, packet=packet, segments=segments))
            assert audio.samples == s and audio.streams == streams
            if n:
                parts = [sum(len(s[i : i + packet]) for i in range(k * packet, n, streams * packet)) for k in range(streams)]
                assert max(audio.times) == max(parts) / audio.rate


def test_damage():
    data = ogg.write(random.Random(2).randbytes(40_000))
    for at in range(0, len(data), 997):
        with pytest.raises(ogg.Damaged):
            ogg.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.Damaged):
        ogg.read(data[:-100])


def test_columns(spark):
    rows = [(1, "é" * 40, "clash"), (2, None, None), (3, "", None), (4, "a" * 64, None), (5, "b" * 65, None), (6, "é" * 40, None), (7, "long " * 60_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {g.doc_id: g for g in ogg.read_column(ogg.store_column(df)).collect()}
    for k, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[k]
        assert (g.n_bytes, g.payload_bytes, bytes(g.payload), g.payload_sha256, g.tail_crc32, g.media_bytes) == (len(raw), len(payload), payload, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(g.media))
    assert got[1].media_sha256 == got[6].media_sha256 and got[1].feature == got[6].feature
    assert ogg.read_column(ogg.store_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_feature_against_a_plain_loop():
    r = random.Random(4)
    for n in (64, 6000, 6001, 30_016):
        samples = r.randbytes(n)
        audio = ogg.read(ogg.write(samples))
        x = [b - 128 for b in samples]
        changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        bands = [sum(b // 32 == k for b in samples) for k in range(8)]
        cut = [samples[i : i + ogg.PACKET] for i in range(0, n, ogg.PACKET)]
        last = max(sum(map(len, cut[s :: ogg.STREAMS])) for s in range(ogg.STREAMS)) / ogg.RATE
        got = dict(p.split("=") for p in ogg.feature(audio).split(";"))
        assert (int(got["streams"]), int(got["changes"]), got["bands"]) == (ogg.STREAMS, changes, ",".join(map(str, bands)))
        assert float(got["seconds"]) == pytest.approx(n / ogg.RATE, abs=1e-6) and float(got["last"]) == pytest.approx(last, abs=1e-6)
        assert float(got["mean"]) == pytest.approx(sum(x) / n, abs=1e-4) and float(got["rms"]) == pytest.approx((sum(v * v for v in x) / n) ** 0.5, abs=1e-4)


def test_helper_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "<p>Some text.", "mine"), (2, None, "mine")], "doc_id long, text string, __text string")
    got = ogg.store_column(d).collect()
    assert [(r.doc_id, r["__text"]) for r in got] == [(1, "mine"), (2, "mine")]
