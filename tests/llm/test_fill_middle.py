import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import fill_middle as f


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by Python's own pattern matching."""
    text = text or ""
    cuts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % len(cuts), h[1] % len(cuts)))
    a, b = cuts[a], cuts[b]
    if not text or any(m in text for m in f.MARKS) or h[2] % 100 >= 90:
        return len(cuts) - 1, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(cuts) - 1, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(cuts) - 1, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", "ab c", "éa😀b\u2028c\r\n", "x" * 5000, "<P", "a <S", "a<P>b", "<M>", "<<S", "P>", "a\x00b", "tab\tline\nend "] + [f"some words, {i} of them\n" * (i % 7) for i in range(120)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (3, "a"), (7, "another of the same id")]


def test_equals_plain_cuts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = f.fill_middle(docs, keep=["doc_id", "text"]).withColumn("restored", f.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, *plain(r.doc_id, r.text)) for r in out), key=str) == sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str) and all(r.restored == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_rates_seed_and_marks(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = f.fill_middle(docs, moved=100, suffix_first=100, seed=5, marks=("(", ")", "[.]")).collect()
    assert {r.form for r in every} == {"plain", "spm"} and all(r.form == "plain" or r.output.startswith(")") for r in every)
    assert {r.form for r in f.fill_middle(docs, moved=0).collect()} == {"plain"}
    assert f.fill_middle(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", "y")], "doc_id long, text string, n long, output string, output_in string")
    r = f.fill_middle(docs, keep=["doc_id", "n", "output", "output_in"]).first()
    assert (r.n_in, r.n, r.output_in) == (5, 5, "y") and "x" in tuple(r)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abZ z\n9é😀<"), max_size=80), st.integers(1, 9))
def test_blocks_give_the_same_offsets(text, block):
    assert f.offsets(text, block=block).tolist() == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]


def test_a_very_long_text():
    text = "word, " * 60_000 + "z" * 300_000 + " end"
    found = f.offsets(text)
    assert len(found) == 60_000 * 3 + 4 and found[-1] == len(text) and text[found[-3] : found[-2]] == " "


@pytest.mark.parametrize("text", ["", "a", "1", "aZ9 é́x\n\nb", "▁a b\U0001f600c ÄbC", "ab" * 40 + " c"])
def test_two_places_equal_all_offsets(text):
    every = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    for one, two in ((0, 0), (5, 123456), (2**32 - 1, 7), (len(every) - 1, 0)):
        x, y = sorted((one % len(every), two % len(every)))
        assert f.placed(text, one, two) == f.placed(text, one, two, block=3) == (len(every) - 1, every[x], every[y])
