import hashlib

import zstandard

from quarry.llm import warc as op
from quarry.llm.aligned import file_system
from quarry.llm.common import new_path

DATE = "2024-05-06T07:08:09Z"
BIG, OTHER = "<p>é" * 400, "x" * 1000
PAGES = [(1, "http://a/", BIG), (5, None, BIG), (3, "http://b\r\n/", BIG), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", OTHER), (9, "u", OTHER), (None, "u", OTHER), (10, "u", "y" * 300_000), (11, "u", "z" * 999), (12, "u", "z" * 999)]


def frame(spark, pages):
    return spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, block int, row string")


def test_round_trip(spark):
    folder = new_path(spark, "test")
    archives = op.write(frame(spark, PAGES), folder, DATE)
    got = sorted(map(tuple, op.read(archives).drop("html").collect()), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        to = {BIG: 5, OTHER: 9}.get(html)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to and page != to else "response", to if to and page != to else None))
    want.remove(next(w for w in want if w[0] == 9))  # of the two equal rows one revisits the other
    want.append((9, 1000, hashlib.sha1(OTHER.encode()).hexdigest(), "revisit", 9))
    assert got == sorted(want, key=str)
    assert {r["page_id"]: r["html"] for r in op.read(archives).where("record_type = 'response'").collect()}[5] == BIG
    for row in archives.collect():
        where, at = file_system(row["uri"])
        data = where.open_input_stream(at).read()
        assert int.from_bytes(data[:4], "little") == op.SKIPPABLE
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")  # a frame for this record alone
        assert first.endswith(b"\r\n\r\n") and b"response" not in first


def test_revisits_name_their_records(spark):
    archives = op.write(frame(spark, PAGES).coalesce(1), new_path(spark, "test"), DATE)
    heads = [h for r in archives.collect() for h, _ in op.read_archive(r["uri"])]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(PAGES) and all(h["WARC-Date"] == DATE for h in heads)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            of = ids[h["WARC-Refers-To"]]
            assert of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and of.get("WARC-Target-URI") == h.get("WARC-Refers-To-Target-URI")


def test_rolls_archives(spark, monkeypatch):
    monkeypatch.setattr(op, "ARCHIVE_BYTES", 200)
    archives = op.write(frame(spark, PAGES), new_path(spark, "test"), DATE)
    assert archives.count() > 2 and op.read(archives).count() == len(PAGES)


def test_empty(spark):
    archives = op.write(frame(spark, []), new_path(spark, "test"), DATE)
    assert archives.count() == 0 and op.read(archives).count() == 0
