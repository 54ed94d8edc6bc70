import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import near_copies, simhash

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPS))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts):
    """Brute force over all pairs, by the similarity alone: the smallest position that each can reach."""
    sets = [plain(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    least, changed = list(range(len(sets))), True
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= (least[i], least[j]) != (m, m)
            least[i] = least[j] = m
    return least


def corpus(rng):
    """Texts, chains of changed copies, one large group of near copies, and a line that many share."""
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    changed = lambda w, n: [word() if i in at else x for at in [set(rng.sample(range(len(w)), n))] for i, x in enumerate(w)]
    base = [[word() for _ in range(rng.randint(1, 90))] for _ in range(40)]
    out, line = list(base), [word() for _ in range(9)]
    for b in base[:20]:
        for _ in range(4):
            b = changed(b, min(len(b), rng.randint(0, 2)))
            out.append(b)
    group = [word() for _ in range(70)]
    out += [changed(group, rng.randint(0, 4)) for _ in range(60)] + [[word() for _ in range(25)] + line for _ in range(40)]
    return [" ".join(w) for w in out] + [out[3][0].upper(), None, "", " \n", "One", "one", "a b c d", "A b  c d"]


def test_prefixes_of_similar_sets_meet():
    sets = [near_copies.shingles((t or "").encode()) for t in corpus(random.Random(2))]
    last = sets[-60][:30]
    for some in (None, last):
        heads = [set(np.concatenate(near_copies.prefix(s, 0.8, some)).tolist()) for s in sets]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if near_copies.similar(a, b, 0.8):
                    assert heads[i] & heads[j]


def test_fingerprints_part_no_similar_sets():
    """The bits that differ are never more than the shingles that do, at any width."""
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (5, 4), (40, 44), (130, 120), (700, 640), (3000, 2500)]:
        pool = rng.integers(0, 1 << 63, 4000).astype("u8")
        for _ in range(30):
            a = np.unique(rng.choice(pool, n, False))
            b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.choice(pool, m // 3))))
            x, y = near_copies.parities(a), near_copies.parities(b)
            differ = len(np.setxor1d(a, b))
            f, g = (near_copies.folded(w, 64) for w in (x, y))
            narrow = int(np.bitwise_count(f ^ g).sum())
            counted = int(np.bitwise_count(near_copies.counts_of(f) ^ near_copies.counts_of(g)).sum())
            assert counted <= narrow <= differ and near_copies.apart(x, y) <= differ
            if near_copies.similar(a, b, 0.8):
                assert differ <= near_copies.most_apart(len(a), len(b), 0.8)


def test_classes_equal_brute_force(spark):
    texts = corpus(random.Random(3))
    docs = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "_a long, _b long, text string").repartition(3)
    want = classes(texts)
    assert len(texts) > 200 and 60 < len(set(want)) < len(texts) - 60
    # With hardly any leaders all is left to blocks, here of three sets.
    for crowded, leaders, block in ((2, 5, 2048), (32, 5, 2048), (2, 0, 3)):
        got = {r._a: r["class"] for r in near_copies.classes_of(docs, crowded=crowded, leaders=leaders, block=block).collect()}
        assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))
    assert near_copies.classes_of(docs.limit(0)).count() == 0


def test_sets_of_a_template(spark):
    """Hundreds of texts that share most of a form but are not similar, and some that are, all in the form's cells."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    form = [word() for _ in range(60)]
    texts = [" ".join(form + [word() for _ in range(rng.randint(8, 22))]) for _ in range(150)]
    texts += [" ".join([*t.split()[:-1], word()]) for t in texts[:25]]
    docs = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "_a long, _b long, text string").repartition(3)
    want = classes(texts)
    for block in (2048, 20):
        got = {r._a: r["class"] for r in near_copies.classes_of(docs, crowded=4, leaders=1, block=block).collect()}
        assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_stage_finds_copies_beyond_two_bits(spark):
    texts = corpus(random.Random(4))
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(classes(texts))) and {tuple(r) for r in got} <= set(rows)
    f = [simhash.fingerprint_of(t or "") for t in texts]
    assert any(bin((f[i] ^ f[c]) & (1 << 64) - 1).count("1") > 2 for i, c in enumerate(classes(texts)) if c != i)


def test_cells_of_one_batch_and_of_many_rows():
    """Cells that pass by in several batches are paired once; crowded ones come out whole, wherever batches are cut."""
    import pyarrow as pa

    rng = random.Random(6)
    rows = sorted((c, s, 10, 0, 0) for c, n in ((1, 1), (5, 3), (6, 40), (9, 33), (12, 32), (13, 2)) for s in rng.sample(range(1000), n))
    for width in (1, 2, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + width])], names=list(near_copies.CELL)) for i in range(0, len(rows), width)]
        got = pa.Table.from_batches(near_copies._paired(0.8, 32)(iter(batches)), schema=pa.schema([("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("f", pa.int64())])).to_pylist()
        many = [(r["c"], r["a"], r["n"], r["f"]) for r in got if r["b"] is None]
        assert sorted(many) == [r[:4] for r in rows if r[0] in (6, 9)]
        assert sum(r["b"] is not None for r in got) == 3 + 32 * 31 // 2 + 1


def test_segments_of_majority_fingerprints_come_first(spark):
    """All fingerprints within two bits are joined through the grid, crowded or not, and what is verified there is looked at no more."""
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [prints[0] ^ 1 << k for k in range(64)] + [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in prints[:30]] + prints[5:9]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    got = near_copies.by_segments(spark.createDataFrame([(i, signed(m)) for i, m in enumerate(prints)], "s long, m long")).collect()
    least, changed = list(range(len(prints))), True
    own, want = least.copy(), least
    while changed:
        changed = False
        for known, links in ((own, [(r.a, r.b) for r in got]), (want, [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])):
            for i, j in links:
                m = min(known[i], known[j])
                changed |= (known[i], known[j]) != (m, m)
                known[i] = known[j] = m
    assert own == want and 40 < len(set(want)) < 100
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 2 for r in got)
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 6), (6, 6)], "node long, component long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 7), (6, 7), (8, 9), (1, 8)], "a long, b long")
    assert sorted(map(tuple, near_copies.parted(pairs, classes).collect())) == [(1, 8), (3, 7), (8, 9)]


def test_only_sets_of_pairs_are_joined(spark):
    sets = spark.range(9).select(F.col("id").alias("s"), F.lit(b"x").alias("held"))
    pairs = spark.createDataFrame([(1, 2), (2, 7), (1, 40)], "a long, b long")
    assert sorted(r.s for r in near_copies.only(sets, pairs).collect()) == [1, 2, 7]
    assert near_copies.only(sets, pairs, most=3).count() == 9 and near_copies.only(sets, pairs.limit(0)).count() == 0


def test_encoders_of_earlier_stages_are_let_go():
    import pyarrow as pa

    from factweave.llm import tokens

    tokens.load(tokens.public_vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b c", b"a b c d e f"], pa.binary())], names=["b"])
    assert list(near_copies._repeated(5)(iter([batch])))[0].num_rows == 0
    assert tokens.load.cache_info().currsize == 0


def test_workers_hold_one_encoder_at_a_time():
    import pyarrow as pa

    from factweave.llm import merge_encoding, tokens
    from factweave.llm.common import let_go

    model = tokens.public_vocabulary()
    tokens.load(model), merge_encoding.load(model)
    let_go(merge_encoding.load)
    assert (tokens.load.cache_info().currsize, merge_encoding.load.cache_info().currsize) == (0, 1)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b c"], pa.binary())], names=["b"])
    assert list(near_copies._repeated(5)(iter([batch])))[0].num_rows == 0
    assert merge_encoding.load.cache_info().currsize == 0


def test_batches_of_long_texts_are_short(spark, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    monkeypatch.setattr(near_copies, "BATCH", 1 << 20)
    monkeypatch.setattr(near_copies, "_classes", lambda docs, *_: [r.n for r in docs.mapInArrow(sizes, "n long").collect()])
    found = near_copies.classes_of(spark.range(0, 900, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")))
    assert len(found) > 5 and max(found) < 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
