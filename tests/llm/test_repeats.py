import hashlib
import random
from collections import Counter

import numpy as np

from factweave.llm import repeats


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], hit.astype("i1")))) == 1).sum())
        left = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(rng, n=60):
    """Texts of few letters that share passages with small changes, copies, runs and periods."""
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300))) for _ in range(n)]
    passage = "".join(rng.choice("abc ") for _ in range(150))
    out = []
    for b in base:
        cut = sorted(rng.sample(range(151), 2))
        out.append(b[: rng.randint(0, 300)] + passage[cut[0] : cut[1]] + rng.choice(base)[: rng.randint(0, 200)])
    return out + base[:10] + [out[3], "a" * 400, "ab" * 150, "ba" * 100 + passage, passage, passage, "", None, "x"]


def test_stretches_cover_all_strings_and_agree():
    rng = random.Random(2)
    for text in corpus(rng):
        b = (text or "").encode()
        lo, hi, at, k = repeats.stretches(b, 40, 8)
        assert [i for a, z in zip(lo, hi) for i in range(a, z + 1)] == list(range(max(0, len(b) - 39)))
        for a, z, p, h in zip(lo, hi, at, k):
            assert z <= p <= a + 32
            for s in {a, z}:
                own = repeats.stretches(b[s : s + 40], 40, 8)
                assert (own[2][0] + s, own[3][0]) == (p, h)


def test_interval_tree():
    words = [b"banana", b"bandana", b"ban", b"apple", b"band"]
    order, lcp = repeats.ordered(words)
    got = {(d, tuple(sorted(words[order[i]] for i in range(a, b + 1)))) for d, a, b in repeats.intervals(lcp, len(words))}
    assert got == {(0, tuple(sorted(words))), (3, (b"ban", b"banana", b"band", b"bandana")), (4, (b"band", b"bandana"))}


def test_maximal_repeats_have_all_occurrences():
    lefts, rights = [b"ba", b"ba", b"ca", b"x"], [b"xyz1", b"xyz2", b"xyz1", b"xyz3"]
    got = {(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats(lefts, rights, 4)}
    assert got == {(2, 3, (0, 1)), (0, 4, (0, 2))}
    assert (0, 3, (0, 1, 2, 3)) in {(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats(lefts, rights, 3)}


def test_equals_brute_force(spark):
    for seed, crowded in ((1, 256), (2, 2)):
        texts = corpus(random.Random(seed))
        rows = [(i, t, 0) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(5)
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(docs, length=40, gram=8, crowded=crowded).collect()}
        want = plain(texts, 40)
        assert [got[i] for i in range(len(texts))] == want
        assert sum(w[1] for w in want) > 1000


def groups_of(spark, texts, length=40, gram=8, crowded=256):
    frame = spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate(texts)], "d long, e long, b binary").repartition(3)
    groups = {}
    for r in repeats.repeat_groups(frame, length, gram, crowded).collect():
        groups.setdefault(r.repeat, set()).add((r.d, r.start, texts[r.d][r.start : r.start + r.n_bytes]))
    return groups


def maximal(texts, length):
    """Brute force: every string of at least `length` bytes with two or more occurrences that neither all continue alike nor all follow the same byte; with all occurrences."""
    level = {}
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            level.setdefault(b[i : i + length], []).append((d, i))
    level, out, n = {w: o for w, o in level.items() if len(o) > 1}, {}, length
    while level:
        longer = {}
        for w, places in level.items():
            after = [texts[d][i + n : i + n + 1] for d, i in places]
            before = [texts[d][i - 1 : i] if i else b"" for d, i in places]
            if (len(set(after)) > 1 or after[0] == b"") and (len(set(before)) > 1 or before[0] == b""):
                out[w] = set(places)
            for c, p in zip(after, places):
                if c:
                    longer.setdefault(w + c, []).append(p)
        level, n = {w: o for w, o in longer.items() if len(o) > 1}, n + 1
    return out


def test_groups_hold_equal_strings_and_all_that_repeats(spark):
    texts = [(t or "").encode() for t in corpus(random.Random(5))]
    want = plain([b.decode() for b in texts], 40)
    for crowded in (2, 256):
        groups, hit = groups_of(spark, texts, crowded=crowded), [np.zeros(len(b), bool) for b in texts]
        for g in groups.values():
            assert len({s for *_, s in g}) == 1 and len(g) > 1
            for d, start, s in g:
                assert len(s) >= 40
                hit[d][start : start + len(s)] = True
        assert [int(h.sum()) for h in hit] == [w[1] for w in want]


def test_groups_are_the_maximal_repeats(spark):
    """Long repeats are whole, also around a part that occurs elsewhere too; every group lists all of its occurrences."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    inner, outer = text(700), (text(900), text(800))
    long = outer[0] + inner + outer[1]
    texts = [text(100) + long + text(50), text(300) + long, text(20) + inner + text(200), text(90) + outer[0][:500] + text(10), long[1000:1500] + text(5) + long[1000:1480], text(3000), b""]
    texts += [text(30) + texts[5][500:1500] + text(40), texts[5][1200:2500], text(700)] + [text(60)] * 2
    want = {(w, tuple(sorted(o))) for w, o in maximal(texts, 40).items()}
    for crowded in (256, 2):
        got = {(next(iter(g))[2], tuple(sorted((d, i) for d, i, _ in g))) for g in groups_of(spark, texts, crowded=crowded).values()}
        assert got == want and max(len(w) for w, _ in got) == len(long)


def test_a_long_shared_passage_is_one_group(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    passage = text(5000)
    groups = groups_of(spark, [text(900) + b"1" + passage + b"2" + text(1200), b"x" + passage + text(30), text(2000)], 400, 64)
    assert [sorted((d, i, len(s)) for d, i, s in g) for g in groups.values()] == [[(0, 901, 5000), (1, 1, 5000)]]


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) + passage[: 100 + n] + "z" * (n % 7) for n in (0, 5, 300, 777)]
    monkeypatch.setattr(repeats, "BLOCK", 50)
    parts = [(b, repeats.stretches(b, 40, 8)) for b in (t.encode() for t in texts)]
    monkeypatch.undo()
    by = {}
    for n, (b, (lo, hi, at, k)) in enumerate(parts):
        for a, z, p, h in zip(lo.tolist(), hi.tolist(), at.tolist(), k.tolist()):
            by.setdefault(h, []).append((n, a, p - a, b[a : z + 40]))
    hit = [set() for _ in texts]
    for found in by.values():
        for (n, a, *_), ranges in zip(found, repeats.repeated_starts([f[2:] for f in found], 40)) if len(found) > 1 else ():
            hit[n] |= {i for x, y in ranges for i in range(a + x, a + y + 1)}
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    assert hit == [{i for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1} for t in texts]


def test_rows(spark):
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long, "x"), (1, long, "x"), (None, long[:500], None), (None, None, None), (2, "", "y"), (3, long[:399], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lo string")
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows], 400))], key=str)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
