"""Exact round trips through bundles, and the decisions about equal payloads."""

import hashlib

from folioframe.llm import warc


def rows(spark):
    big, other = "é<p>x</p>\r\n\r\n" * 200, "y" * 400_000
    html = [big, None, "", "small", "small", big, other, "z" * 999, "z" * 999, big]
    return html, spark.createDataFrame([(i, f"http://h/{i}\n" if i % 3 else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    html, pages = rows(spark)
    index = warc.archive(pages.repartition(3))
    back = {r.page_id: r for r in warc.read(index).collect()}
    assert len(back) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        keep = max(k for k, x in enumerate(html) if x == h)
        revisit = len(raw) >= 1000 and keep != i
        r = back[i]
        assert (r.record_type, r.refers_to) == (("revisit", keep) if revisit else ("response", None))
        assert r.payload_digest == hashlib.sha1(raw).hexdigest() and r.payload_bytes == len(raw)
        assert r.payload is None if revisit else bytes(r.payload) == raw
        assert r.url == (f"http://h/{i}%0A" if i % 3 else None)
    one = warc.fetch(index, spark.createDataFrame([(6,), (2,)], "page_id long")).collect()
    assert {r.page_id: bytes(r.payload) for r in one} == {6: html[6].encode(), 2: b""}


def test_frames_stand_alone(spark, tmp_path):
    b = warc.Bundle(f"file://{tmp_path}")
    for i in range(40):
        b.add(i, warc.record(i, "u", b"q" * 20_000, hashlib.sha1(b"q" * 20_000).hexdigest(), "response", None, "d"))
    index = b.close()
    r = warc.Reader(b.path)
    assert len(r.sizes) > 2
    for page_id, _, _, frame, offset, length in index:
        assert warc.parse(memoryview(r.frame(frame))[offset : offset + length])[0] == page_id


def test_empty(spark):
    assert warc.read(warc.archive(rows(spark)[1].limit(0))).count() == 0
