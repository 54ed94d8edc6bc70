import re
from collections import defaultdict

from factweave.llm import mixing


def filled(sizes, weights=(5, 2, 1)):
    """Targets by giving the excess back again and again."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return t | {s: 2.0 * sizes[s] for s in full}
        full |= over


def checked(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = filled(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), words(t)) for d, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        taken[r.source] += r.copies * r.size
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_and_words(spark):
    rows = [(i, "w " * (i * 37 % 211 + 1), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for slices in (2, 4096):
        out = mixing.mix(docs, ["doc_id", "source"], slices=slices).collect()
        for have, want in checked(rows, out).values():
            assert abs(have - want) <= 212, (have, want)
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert sorted(again) == sorted(out)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x " * 90000, "b"), (5, "e", None), (6, "", "empty"), (7, "z é\x85", "É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as whole", "3 as digits")
    got = mixing.mix(docs, ["doc_id", "source", "whole", "digits"]).collect()
    checked(rows, got)
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = docs.where("size(split(text, ' ')) > 9 and doc_id > 0 or text = ''")
    assert {(r.copies, r.target) for r in mixing.mix(nothing).collect()} == {(0, 0.0)}


def test_longer_classes_are_preferred(spark):
    rows = [(i, "w " * (1 if i % 2 else 1000), f"s{i % 3}") for i in range(1200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).where("source = 's2'").collect()
    share = lambda n: sum(r.copies for r in out if r.size == n) / sum(1 for r in out if r.size == n)
    assert share(1000) > share(1)
