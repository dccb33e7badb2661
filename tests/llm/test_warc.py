"""WARC archives: round trips, faults and odd rows."""

import hashlib
import random

import pytest
import zstandard

from ventara.llm import warc
from ventara.llm.base import Scratch


def _plain(rows):
    """[(page, size, digest, type, refers_to)] in the order of rows (page, url, html)."""
    out, latest = [], {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= warc.LEAST and page is not None:
            latest[data] = max(latest.get(data, page), page)
    for page, _, html in rows:
        data = (html or "").encode()
        other = latest.get(data)
        again = other is not None and other != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", other if again else None))
    return out


LONG = "<p>é😀 some words of a page</p>" * 60
ROWS = [
    (1, "http://a/x y\r\n", LONG), (2, "u", LONG), (9, None, LONG), (9, "u", LONG), (None, "u", LONG), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "x" * 1000), (6, "u", "x" * 1000),
    (7, "u", None), (8, "u", ""), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (10, "u", "WARC/1.1\r\n\r\n\x00\r\n\r\n"), (-11, "u", "P*M\x18\x00\x00\x00\x00" * 300), (12, "u", "y" * 3_000_000),
]


@pytest.mark.parametrize("size,broadcast", [(warc.ARCHIVE_BYTES, warc.BROADCAST), (500, 0)])
def test_odd_rows(spark, monkeypatch, size, broadcast):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    df = spark.createDataFrame([(*r, "a", 1) for r in ROWS], "page_id long, url string, html string, archive string, digest int").repartition(3)
    got = warc.archived(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, _plain(ROWS)))


def test_empty_tables(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert [tuple(r)[1] for r in warc.archived(spark.createDataFrame([(1, None, None)], "page_id int, url string, html string")).collect()] == [0]


def test_payloads_come_back(spark):
    scratch = Scratch(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"), scratch.path("archives"), scratch)
    got = warc.read_archives(spark, scratch.path("archives")).collect()
    assert not any(r["fault"] for r in got) and len(got) == len(ROWS)
    want = sorted((r[2] or "").encode() for r, p in zip(ROWS, _plain(ROWS), strict=True) if p[3] == "response")
    assert sorted(bytes(r["payload"]) for r in got if r["payload"] is not None) == want
    assert {r["target_uri"] for r in got if r["record_id"] == "<urn:page:1>"} == {"http://a/x%20y%0D%0A"}
    scratch.drop()


def _archive(records, dictionary=b"", packed=True):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(dict_data=held)
    first = warc.skippable(zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary) if dictionary else b""
    return first + b"".join(map(writer.compress, records))


def _record(payload=b"text"):
    return warc.record(1, "u", payload, len(payload), hashlib.sha1(payload).hexdigest(), None)


def test_foreign_archives():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abcdef", k=5)) for _ in range(50)]
    texts = [b" ".join(rng.choices(words, k=300)) for _ in range(100)]
    dictionary = zstandard.train_dictionary(2000, texts).as_bytes()
    records = [_record(t) for t in texts]
    for data in (_archive(records), _archive(records, dictionary), _archive(records, dictionary, packed=False), _archive(records, b"plain text " * 40)):
        assert [r["payload"] for _, r, _ in warc.read_archive(memoryview(data))] == texts
    stream = zstandard.ZstdCompressor().compressobj()  # a frame without its size
    data = stream.compress(records[0]) + stream.flush()
    assert [r["payload"] for _, r, _ in warc.read_archive(memoryview(data + warc.BETWEEN.encode() + data))] == texts[:1] * 2


def test_faults():
    good = _record()
    assert warc.parse(good)["payload"] == b"text"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/x"), good.replace(b"WARC-Date", b"Date"), good.replace(b"text\r\n\r\n", b"tent\r\n\r\n"), good.replace(b"HTTP/1.1", b"HTTQ/1.1"), good.replace(b"Content-Length: 4\r", b"Content-Length: 5\r"), b"", b"WARC/1.1\r\nnone\r\n\r\n", good.replace(b"response", b"revisit", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    data = _archive([good, good[:-1], good])
    assert [f is None for _, _, f in warc.read_archive(memoryview(data))] == [True, False, True]
    assert [f is None for _, _, f in warc.read_archive(memoryview(data[:-3]))] == [True, False, False]
    assert [f is None for _, _, f in warc.read_archive(memoryview(_archive([good]) + b"junk"))] == [True, False]
    assert list(warc.read_archive(memoryview(b""))) == []
    wrong = bytearray(_archive([good, good], b"plain text " * 40))
    wrong[1] ^= 1  # no leading dictionary frame any more
    assert any(f for _, _, f in warc.read_archive(memoryview(bytes(wrong))))
