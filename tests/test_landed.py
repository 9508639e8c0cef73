import gzip
import io
import os
import random
import time

import pytest
from pagetide.operators.crawl import MAX_HTML_BYTES
from pagetide.sources import landed

OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record(kind, url, block, **more):
    fields = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": "2026-01-02T03:04:05Z", "Content-Length": str(len(block)), **more}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url, body, head=OK):
    return record("response", url, head + b"\r\n" + body)


PAGES = [
    (response("https://e.org/a", "<p>é".encode()), "html"),
    (record("request", "https://e.org/a", b"GET /a HTTP/1.1\r\n\r\n"), None),
    (response("https://e.org/b", b"", b"HTTP/1.1 302 Found\r\nLocation: /\r\n"), "redirect"),
    (response("https://e.org/c", b"gone", b"HTTP/1.1 404 Not Found\r\n"), "http_error"),
    (response("https://e.org/d", b"%PDF", b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n"), "non_html"),
    (response("https://e.org/e", b"\xff\xfe<p>"), "parse_error"),
    (response("https://e.org/f", b"x" * (MAX_HTML_BYTES + 1)), "oversized"),
    (response("https://e.org/g", b"x" * MAX_HTML_BYTES), "html"),
    (response("https://e.org/h", b"x", OK + b"Content-Length: 3000000\r\n"), "oversized"),
    (record("metadata", "https://e.org/i", b"failure: timeout\r\n"), "timeout"),
    (record("metadata", "https://e.org/i", b"via: x\r\n"), None),
    (record("warcinfo", "", b"software: x\r\n"), None),
    (record("response", "https://e.org/j", b"no http at all"), "network_error"),
]


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    landed.register(spark)


@pytest.mark.parametrize("zipped", ["no", "whole", "each"])
def test_outcomes(spark, tmp_path, zipped):
    """Plain files, zipped ones, and ones whose records are zipped each."""
    rnd = random.Random(1)
    pages = [p for p in PAGES]
    for k in range(3):
        rnd.shuffle(pages)
        parts = [p for p, _ in pages]
        data = b"".join(parts) if zipped == "no" else gzip.compress(b"".join(parts)) if zipped == "whole" else b"".join(map(gzip.compress, parts))
        (tmp_path / f"{k}.warc").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"not a file of it")
    (tmp_path / ".temporary").write_bytes(b"nor this")
    rows = landed.with_outcome(spark.read.format("landed_crawl").load(str(tmp_path)))
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r.url[-1], r.outcome, r.html is not None) for r in rows.collect())
    assert got == sorted(3 * [(chr(97 + k), o, o == "html") for k, o in enumerate(["html", "redirect", "http_error", "non_html", "parse_error", "oversized", "html", "oversized", "timeout", "network_error"])])
    a = rows.where("url LIKE '%/a'").first()
    assert a.html == "<p>é" and str(a.fetched_at) == "2026-01-02 03:04:05" and a.body_bytes == 5
    f = rows.where("url LIKE '%/f'").first()
    assert f.body_bytes == MAX_HTML_BYTES + 1 == len(f.body)


@pytest.mark.parametrize("chunk", [1, 7, 64, 5000])
def test_records_in_pieces(chunk, monkeypatch):
    monkeypatch.setattr(landed, "CHUNK", chunk)
    data = b"".join(p for p, _ in PAGES if len(p) < 5000)
    want = list(landed.responses(landed.Pieces(io.BytesIO(data))))
    assert len(want) == 8
    for other in (gzip.compress(data), gzip.compress(data[:100]) + gzip.compress(data[100:]), b"\r\n\r\n" + data + b"\r\n"):
        assert list(landed.responses(landed.Pieces(io.BytesIO(other)))) == want


def test_bodies_are_cut_but_counted():
    data = response("u", b"x" * 1000) + response("v", b"y")
    rows = list(landed.responses(landed.Pieces(io.BytesIO(data)), 10))
    assert [(r[0], r[6], len(r[7])) for r in rows] == [("u", 1000, 11), ("v", 1, 1)]


def test_damaged_files(spark, tmp_path):
    whole = response("https://e.org/a", b"<p>" * 100)
    for data in (whole[:-50], gzip.compress(whole)[:-9], b"<html>\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(landed.responses(landed.Pieces(io.BytesIO(data))))
    assert list(landed.responses(landed.Pieces(io.BytesIO(b"")))) == []
    (tmp_path / "a").write_bytes(whole[:-50])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("landed_crawl").load(str(tmp_path)).collect()


def test_stream_resumes_where_it_was(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, *urls):
        (folder / f"{name}.tmp").write_bytes(b"".join(response(u, b"<p>") for u in urls))
        os.utime(folder / f"{name}.tmp", (time.time() - 60 + len(list(folder.iterdir())),) * 2)
        os.rename(folder / f"{name}.tmp", folder / f"{name}.warc")

    def run():
        stream = spark.readStream.format("landed_crawl").load(str(folder))
        q = stream.select("url", "status").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(r.url for r in spark.read.schema("url string, status int").parquet(str(tmp_path / "out")).collect())

    land("b", "u1", "u2")
    assert run() == ["u1", "u2"]
    land("a", "u3")  # earlier by name, later by time
    land("c", "u4")
    assert run() == ["u1", "u2", "u3", "u4"]
    assert run() == ["u1", "u2", "u3", "u4"]
    (folder / "new.warc").write_bytes(response("u5", b""))  # others may still come with its time
    reader = landed.LandedStream(None, {"path": str(folder), "settleSeconds": "1000"})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
