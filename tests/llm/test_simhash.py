import random
import re

import xxhash

from factweave.llm import components, simhash

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPS))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Brute force: the smallest position that each can reach."""
    least = list(range(len(prints)))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= (least[i], least[j]) != (m, m)
            least[i] = least[j] = m
    return least


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for t in [None, "", " \n", "One", "One two", "A b C d E É ſ\x85x y z", "z " * 50, "\x1cA\x1d b c"]:
        assert simhash.fingerprint_of(t or "") == signed(plain(t)), t


def test_classes_of_sparse_and_crowded_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = base + [x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) for x in base[:90]]
    prints += [base[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(400)] + [0, 0, 1, 1 << 63, (1 << 64) - 1]
    for crowded in (2, 32):
        points = spark.createDataFrame([(signed(p),) for p in sorted(set(prints))], "f long")
        links = [tuple(r) for r in simhash.near_pairs(points, crowded=crowded).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links)
        found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        order = sorted({signed(p) for p in prints})
        least = classes([x & (1 << 64) - 1 for x in order])
        assert [found.get(x, x) for x in order] == [order[i] for i in least]


def test_rows(spark):
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
    rows = [(5, "a b c d", 1), (3, "A B c d", 2), (9, None, 3), (4, "", 4), (7, long, 5), (8, long + " end", 6), (8, long + " end", 6), (None, "lonely words here now", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f int")
    got = [tuple(r)[:4] for r in simhash.near_duplicates(docs, keep=["doc_id", "f"]).collect()]
    prints = [plain(t) for _, t, _ in rows]
    least = classes(prints)
    groups = {g: min((r[0] for r, x in zip(rows, least) if x == g and r[0] is not None), default=None) for g in set(least)}
    want = [(r[0], r[2], f"{p:016x}", groups[x]) for r, p, x in zip(rows, prints, least)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_very_long_text(monkeypatch):
    """Bits are counted in portions; a long text has the fingerprint of plain counting."""
    rng = random.Random(11)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(500)) for _ in range(20_000))
    monkeypatch.setattr(simhash, "ROWS", 1000)
    assert simhash.fingerprint_of(text) == signed(plain(text))


def test_finer_grids():
    """All pairs within the radius share a cell of every grid; grids grow finer with the number of points."""
    rng = random.Random(12)
    embedded = lambda f: sum(((f >> 2 * k & 1) + (f >> 2 * k + 1 & 1) and (1 if (f >> 2 * k & 3) != 3 else 3)) << 2 * k for k in range(32))
    for radius in (2, 3):
        assert simhash.grids(radius, 100)[0] == radius + 2 and simhash.grids(radius, 10**10)[0] > radius + 2 and simhash.grids(radius, 10**30)
        for blocks in simhash.grids(radius, 100):
            masks = [m & (1 << 64) - 1 for m in simhash.grid(blocks, radius)]
            for _ in range(200):
                f = rng.getrandbits(64)
                g = f
                for b in rng.sample(range(64), radius):
                    g ^= 1 << b
                a, b = embedded(f), embedded(g)
                assert bin(a ^ b).count("1") <= radius and any(a & m == b & m for m in masks)


def test_other_radii(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({signed(x ^ sum(1 << b for b in rng.sample(range(64), n))) for x in base for n in (0, 1, 3, 4)})
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "f long"), radius=3).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
