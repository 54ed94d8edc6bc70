import hashlib

import zstandard

from factweave.llm import warc

BIG = "<p>again</p>" * 100


def test_bundle_is_plain_zstandard_and_seekable():
    data = [warc.record(i, f"http://x/{i}", b"body %d" % i * i, "d", None, False) for i in range(50)]
    b = warc.Bundle(frame=700)
    places = [b.add(x) for x in data]
    packed = b.finish()
    assert zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True).read() == b"".join(data)
    assert len(warc.seek_table(packed)) == places[-1][0] + 1 > 10
    for i, p in enumerate(places):
        head, block = warc.record_at(packed, *p)
        assert block == b"body %d" % i * i and head["warc-record-id"] == f"<urn:page:{i}>"


def plain(rows):
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = max((x for x in same if x is not None), default=None)
        revisit = len(body) >= 1000 and len(same) > 1 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_rows(spark):
    rows = [(1, "u", BIG, 0), (5, None, BIG, 0), (3, "a\r\nb", BIG, 0), (5, "u", BIG, 0), (None, "u", BIG, 0), (7, "u", None, 0), (8, "u", "", 0), (9, "é", "é" * 500, 0), (10, "é", "é" * 500, 0)]
    rows += [(11, "u", "é" * 499, 0), (12, "u", "é" * 499, 0), (2**62, "u", "x" * 400_000, 0), (None, "u", "y" * 1000, 0), (None, "u", "y" * 1000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = warc.write_archives(pages)
    got = warc.read_archives(spark, path)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == plain(rows)
    assert {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response' and page_id is not null").collect()} == {5: BIG, 7: "", 8: "", 10: "é" * 500, 11: "é" * 499, 12: "é" * 499, 2**62: "x" * 400_000}
    found = warc.look_up(spark, path, spark.createDataFrame([(12,), (3,), (99,)], "page_id long"))
    assert {r.page_id: (r.headers["warc-type"], bytes(r.payload)) for r in found.collect()} == {12: ("response", ("é" * 499).encode()), 3: ("revisit", b"")}
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0
