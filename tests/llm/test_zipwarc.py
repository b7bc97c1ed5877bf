"""ZIP web archives: the standard library reads what is written, and what it writes is read; exact round trips."""

import hashlib
import io
import random
import zipfile

import pytest

from supplymesh.llm import zipwarc

PAGES = "page_id long, url string, html string, digest string"


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("wide", [True, False])
def test_both_ways_with_the_standard_library(wide):
    members = [("a.txt", b"hello"), ("dir/é.bin", bytes(range(256))), ("empty", b"")]
    data = zipwarc.write_zip(members, wide)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in members:
            z.writestr(name, body)
        z.writestr("packed", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    found = zipwarc.ZipDirectory(reader(raw.getvalue()), len(raw.getvalue()))
    assert all(found.whole(n) == b for n, b in members) and found.range("a.txt", 1, 3) == b"ell"
    with pytest.raises(zipwarc.Damaged):
        found.start("packed")
    with pytest.raises(zipwarc.Damaged):
        zipwarc.ZipDirectory(reader(data[:-30]), len(data) - 30)


def test_only_ranges_are_read():
    records = [("u", zipwarc.write_record(i, "u", b"y" * 5000, hashlib.sha256(b"y" * 5000).hexdigest(), None, False)) for i in range(400)]
    data, asked = zipwarc.write_archive(records), []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    first = next(zipwarc.read_archive(read, len(data)))
    assert first.payload == b"y" * 5000 and max(asked) < len(data) // 2 + 70_000
    with pytest.raises(zipwarc.Damaged):
        zipwarc.read_record(zipwarc.write_record(1, None, b"abc", "0" * 64, None, False))


def test_round_trip(spark):
    r = random.Random(6)
    bodies = ["x" * 99, "y" * 100, "z" * 5000, "", "unique " * 40, "é" * 60]
    rows = [(i, f"http://h{i}/\r\nX: y" if i % 7 == 0 else None, r.choice([*bodies, None, f"own {i} " * 30]), "clash") for i in range(200)]
    rows += [(5, rows[5][1], rows[5][2], None), (None, "u", "z" * 5000, None), (1000, "u", "long " * 200_000, None)]
    got = zipwarc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    first = {}
    for k, _, html, _ in rows:
        if html and len(html.encode()) >= 100 and k is not None:
            first[html] = min(k, first.get(html, k))
    want = []
    for k, _, html, _ in rows:
        raw = (html or "").encode()
        other = first.get(html)
        revisit = other is not None and other != k
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(g) for g in got), key=key) == sorted(want, key=key)
    assert zipwarc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_hot_payload(spark, monkeypatch):
    rows = [(None if i % 2 else i, "u", "z" * 500 if i % 3 else f"own {i} " * 40, "") for i in range(300)] + [(i, "u", "pair " * 60 * (1 + i // 2), "") for i in range(1000, 1008)]
    seen = []
    for hot in (1, 1000):
        monkeypatch.setattr(zipwarc, "HOT", hot)
        seen.append(sorted(zipwarc.round_trip(spark.createDataFrame(rows, PAGES)).collect(), key=str))
    assert seen[0] == seen[1] and sum(g.record_type == "revisit" for g in seen[0]) == 199 + 4
