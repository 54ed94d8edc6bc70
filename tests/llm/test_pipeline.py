"""Each stage on its own input, against plain versions of what it does; then the whole."""

import random
from collections import Counter

import pytest
from test_fertility import plain as base_counts
from test_fertility import verdict
from test_near_copies import classes
from test_secret_ledger import plain as secrets

import corpus_pipeline as p
from factweave.llm import tokens


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [(i, text(rng.randint(5, 120)), rng.choice(["en", "de", None]), f"s{i % 5}", 1) for i in range(120)]
    out += [(200 + i, out[i][1], "en", "copies", 1) for i in range(10)] + [(300 + i, out[i][1] + " token=abcdefghijklmnop1 end", "en", "s1", 1) for i in range(20, 40)]
    return out + [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "same " * 80, "en", "s1", 1), out[3], (None, text(60), "en", "s2", 1), (None, text(61), "en", "s3", 1), (7, text(50), "en", "other", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_names():
    assert [n for n, _ in p.STAGES] and len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_quality_rules(spark, docs, rows):
    got = p.quality_rules(spark, docs, "")
    assert got.columns == p.COLUMNS
    want = [r for r in rows if (b := base_counts(r[1])) and verdict(r[1], r[2], b[0], b[4])[1]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and 20 < len(want) < len(rows)


def test_one_of_each_class_stays(spark, docs, rows):
    got = p.near_duplicates(spark, docs, "").collect()
    least = classes([r[1] for r in rows])
    groups = {g: min((r[0] for r, x in zip(rows, least) if x == g and r[0] is not None), default=None) for g in set(least)}
    assert sorted((r.doc_id for r in got), key=str) == sorted(groups.values(), key=str)
    assert {tuple(r) for r in got} <= set(rows)


def test_secrets_go(spark, docs, rows):
    got = {(r.doc_id, r.source): r for r in p.secret_scans(spark, docs, "").collect()}
    for d, t, lang, source, _ in rows:
        r = got[d, source]
        assert r.lang == lang and r.n_chars == (len(r.text) if t is not None else None)
        assert secrets(r.text) == [] and (r.text == t if not secrets(t) else "[secret]" in r.text)


def test_mix(spark, docs, rows):
    got = p.weighted_mix(spark, docs, "").collect()
    taken = Counter(map(tuple, got))
    assert set(taken) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in taken.items())
    words = sum(len((r.text or "").split()) for r in got)
    assert abs(words - 1.5 * sum(len((r[1] or "").split()) for r in rows)) < 121 * 7


def test_encoding(spark, docs, rows):
    library = tokens.load(tokens.public_vocabulary()).library
    got = p.encoded(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.source, r.n_tokens) for r in got), key=str) == sorted(((r[0], r[3], len(library.encode(r[1] or ""))) for r in rows), key=str)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0
