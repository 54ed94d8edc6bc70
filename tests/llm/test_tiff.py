import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import tiff
from factweave.llm.common import text_or_empty


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.text("ab", max_size=900).map(str.encode)))
def test_compressions_round_trip(data):
    assert tiff.unlzw(tiff.lzw(data)) == data
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data


def test_lzw_beyond_one_table():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 30000, "u1").tobytes(), b"the cat sat " * 5000, bytes(20000), rng.integers(0, 3, 40000, "u1").tobytes()):
        assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_of_the_specification():
    """The example of the format's specification: 7 7 7 8 8 7 7 6 6 is clear 7 258 8 8 258 6 6 stop."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data and tiff.unlzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_packbits_of_the_specification():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpackbits(packed, len(plain)) == plain and tiff.packbits(plain) == packed


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_layouts_round_trip(compression, tiled, order):
    payload = (b"some text, again and again " * 900)[: 64 * 350]
    for predictor in (1, 2):
        data = tiff.tiff(payload, compression, predictor, tiled, page=64 * 100, order=order)
        got = list(tiff.pages(data))
        assert [p[2] for p in got] == [100, 100, 100, 50] and b"".join(p[-1] for p in got) == payload
        assert {p[4:7] for p in got} == {(compression, predictor, tiled)}


def test_pages_of_a_table(spark):
    good = tiff.tiff(b"x" * 6400, tiff.LZW, page=1280)
    circle = bytearray(tiff.tiff(b"y" * 64))
    circle[-4:] = circle[4:8]
    rows = [(1, good, 5), (1, good, 5), (None, None, 0), (3, b"", 0), (4, b"II*\0\xff\xff\xff\x7f", 0), (5, bytes(circle), 0), (6, good[:300], 0)]
    files = spark.createDataFrame(rows, "doc_id long, content binary, page int")
    got = tiff.read_pages(files).collect()
    whole = [(1, 5, p, 20, b"x" * 1280) for p in range(5) for _ in range(2)]
    assert sorted((r.file.doc_id, r.file.page, r.page, r.height, bytes(r.pixels)) for r in got if r.error is None and r.page is not None) == sorted(whole)
    assert sorted((r.file.doc_id, r.page) for r in got if r.error) == [(3, None), (4, None), (5, 0), (6, 0)]  # damaged: after no page or one
    assert [r.error for r in got if r.file.doc_id is None] == [None]
    errors = {r.doc_id: r.e for r in files.select("doc_id", tiff.pages_column(F.col("content")).alias("t")).select("doc_id", F.col("t.error").alias("e")).collect()}
    assert errors[1] is errors[None] is None and all(errors[k] for k in (3, 4, 5, 6))
    assert tiff.read_pages(files.limit(0)).count() == 0


def test_features(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é😀" * 1000, "long " * 60000] + [f"text {i} " * i for i in range(40)] + ["a" * 64]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in tiff.media_features(docs, text_or_empty()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = tiff.stored(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[len(texts) - 1][1:]
    assert len({r.feature.split(":", 2)[2][:8] for r in got.values()}) > 4
