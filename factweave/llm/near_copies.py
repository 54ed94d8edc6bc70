"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `similarity`, and the classes that such links make. No similar pair is left out.

First comes the method of `simhash`: majority fingerprints of the shingles, the counts of their 32 segments in grid cells, Manhattan distance, then the bits, and what lies within
RADIUS bits is verified on the whole sets (`by_segments`). The classes of these links are the start.

Texts of similarity 0.8 differ in about 10 of 64 bits of a majority fingerprint, but there is no number of bits within which all of them lie. So the links beyond the
radius are found with a second fingerprint, one of parities, and only sets that are not yet of one class are compared: bit b tells whether an odd number of shingles hash to b. One shingle more or less changes one bit, so the bits that differ are at most as many as the shingles in which two sets
differ, and of similar sets of n and m shingles no more than (n + m) (1 - similarity) / (1 + similarity) do. The Manhattan distance of the counts of a fingerprint's
two-bit segments is below that again. Both are lower bounds, so what they part is never similar; the rest is verified on the whole sets.

Where sets meet. At such radii no grid of segments is selective, so they meet in other cells:

- Put the shingles of all texts in one order. Of two sets that are similar enough, the first n - ceil(similarity * n) + 1 shingles of each share one at least,
  so sets meet in the cells of these shingles only, and no pair is missed. Any order does. Here it is that of the hashes, with shingles of many texts put
  last, so that a line or passage that many texts hold brings none together unless they hold little else.
- A pair of a cell stays if the sizes allow the similarity, if enough of both sets is left from the cell's shingle on (in the first cell of a similar pair that is so), and
  if both distances of the fingerprints do. A pair that stays is looked at with wider fingerprints, of twice as many bits as shingles or more, and then in full.

Cells of few sets are paired while they pass by in order. In cells of many (large groups of near copies), a leader is compared with all others; linked sets are one
class that needs no further comparing. In the first turns each set looks at one cell only, of least hash, which near copies mostly share, so most of a group is one class
after as many comparisons as it has members. After LEADERS turns the sets outside the largest class of a cell are held, in blocks of like size, against the whole cell by their wide
fingerprints. First each gives the nearest set of another class alone, turn after turn until none of these is a link; what is then left in different classes gives all pairs
that the fingerprints can't part, few by then. Cells with the same members are one cell.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import batches_of, let_go, released, small, text_or_empty, written
from factweave.llm.components import connected_components
from factweave.llm.simhash import RADIUS, embedding, majority, near_pairs
from factweave.staging import BROADCAST_ROWS

SHINGLE = 5
SIMILARITY = 0.8
WIDE = 256  # bits of a wide fingerprint at least
CROWDED = 32
LEADERS = 5
ALONE = 3  # of these turns look at one cell of each set
BLOCK = 2048  # sets of a cell that are held against all of it at a time
GROWTH = 1.25  # sizes of a block's sets differ by this factor at most
LAST = 200_000  # most shingles put last; which ones only decides the work
BASE = 0x9E3779B97F4A7C15
SHUFFLE = np.uint64(0xD6E8FEB86659FD93)

SKETCH = "_a long, _b long, s long, n int, f long, m long, w binary, cells array<long>, late array<long>"


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of ASCII lower-cased words, ascending; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words))], "u8")
    each = np.fromiter(map(digest, words), "u8", len(words))
    n = len(words) - shingle + 1
    h = np.zeros(n, "u8")
    for k in range(shingle):
        h = (h ^ each[k : k + n]) * np.uint64(BASE)
        h ^= h >> np.uint64(29)
    return np.unique(h * SHUFFLE)


def ratio(similarity: float) -> tuple[int, int]:
    f = Fraction(str(similarity))
    return f.numerator, f.denominator


def prefix(found: np.ndarray, similarity: float, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in whose cells a set is looked for: those of the common order, and those put last."""
    p, q = ratio(similarity)
    n = len(found)
    take = n - -(-n * p // q) + 1
    if last is None or not len(last):
        return found[:take], found[:0]
    late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    early = found[~late][:take]
    return early, found[late][: take - len(early)]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    p, q = ratio(similarity)
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * q >= p * (len(a) + len(b) - both)


def width_of(n: int) -> int:
    """Bits of the wide fingerprint of n shingles: a power of two, so that it can be folded."""
    return max(WIDE, 1 << (2 * n - 1).bit_length())


def parities(found: np.ndarray) -> np.ndarray:
    """Wide fingerprint of a set: bit b of width_of(n) is the parity of its hashes that are b modulo the width."""
    width = width_of(len(found))
    odd = np.bincount((found & np.uint64(width - 1)).astype("i8"), minlength=width) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<u8")


def folded(wide: np.ndarray, width: int) -> np.ndarray:
    """The same for a smaller width: parities of what falls together add up."""
    return np.bitwise_xor.reduce(wide.reshape(-1, width // 64), axis=0)


def most_apart(n, m, similarity: float):
    """In how many shingles two similar sets of n and m shingles can differ."""
    p, q = ratio(similarity)
    return (n + m) * (q - p) // (q + p)


TEXTS = 2048  # of which shingles are held at a time
PAIRS = 256  # of which both sets are
BATCH = 8 << 20  # bytes of a batch on its way to Python


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _repeated(shingle: int):
    """Shingles that two or more different sets of some thousand texts hold, with their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _slices(batches, TEXTS):
            sets = {x.tobytes() for x in (shingles(t, shingle) for t in batch.column("b").to_pylist())}
            found, n = np.unique(np.frombuffer(b"".join(sets), "i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1].astype("i8"))], names=["c", "n"])

    return count


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view("i8")))


def _sketch(shingle: int, similarity: float, last: np.ndarray):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        for batch in _slices(batches, TEXTS):
            ids, sizes, prints, most, wide, early, late = [], [], [], [], [], [], []
            for text in batch.column("b").to_pylist():
                found = shingles(text, shingle)
                ids.append(xxhash.xxh3_64_intdigest(found))
                sizes.append(len(found))
                wide.append(parities(found))
                prints.append(folded(wide[-1], 64)[0])
                most.append(majority(found))
                for kept, each in zip((early, late), prefix(found, similarity, last)):
                    kept.append(each)
            columns = [batch.column("_a"), batch.column("_b"), pa.array(np.array(ids, "u8").view("i8")), pa.array(sizes, pa.int32()), pa.array(np.array(prints, "u8").view("i8")), pa.array(most, pa.int64()), pa.array([w.tobytes() for w in wide], pa.binary()), _lists(early), _lists(late)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return sketch


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _slices(batches, PAIRS):
            found = [shingles(b, shingle) for b in batch.column("b").to_pylist()]
            sizes, wide = pa.array([len(x) for x in found], pa.int32()), pa.array([parities(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("s"), sizes, wide, pa.array([x.tobytes() for x in found], pa.binary())], names=["s", "n", "w", "held"])

    return sets


def counts_of(f: np.ndarray) -> np.ndarray:
    """simhash.embedding of many fingerprints."""
    low, high = f & np.uint64(0x5555555555555555), f >> np.uint64(1) & np.uint64(0x5555555555555555)
    return low | high | (low & high) << np.uint64(1)


CELL = {"c": "i8", "s": "i8", "n": "i8", "f": "u8", "at": "i8"}


def _paired(similarity: float, crowded: int):
    """Pairs a, b of the sets of each cell; rows (c, s, n, f, at) come ordered by cell. Cells of more than crowded sets come out as rows c, a, n, f instead."""
    p, q = ratio(similarity)

    def near(run: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, s, n, f, at = run
        e = counts_of(f)
        i, j = np.triu_indices(len(s), 1)
        ok = np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p
        i, j = i[ok], j[ok]
        ok = np.minimum(n[i] - at[i], n[j] - at[j]) * (p + q) >= p * (n[i] + n[j])
        i, j = i[ok], j[ok]
        most = most_apart(n[i], n[j], similarity)
        ok = (np.bitwise_count(e[i] ^ e[j]) <= most) & (np.bitwise_count(f[i] ^ f[j]) <= most)
        return s[i[ok]], s[j[ok]]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = [np.zeros(0, t) for t in CELL.values()]
        names = ["c", "a", "b", "n", "f"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        many = None  # a cell that is known to be crowded

        def out(run: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal many
            if len(run[0]) > crowded or len(run[0]) and run[0][0] == many:
                many = run[0][0]
                yield pa.RecordBatch.from_arrays([pa.array(run[0]), pa.array(run[1]), pa.nulls(len(run[0]), pa.int64()), pa.array(run[2].astype("i4")), pa.array(run[3].view("i8"))], names=names)
            elif last and len(run[0]) > 1:
                a, b = near(run)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(len(a), t) for t in types[3:])], names=names)

        for batch in batches:
            rows = [np.concatenate((h, batch.column(k).to_numpy().astype("i8").view(h.dtype))) for h, k in zip(held, CELL)]
            ends = np.append(np.flatnonzero(np.diff(rows[0])) + 1, len(rows[0]))
            begin = 0
            for end in ends[:-1].tolist():
                if end - begin > 1 or rows[0][begin] == many:
                    yield from out([x[begin:end] for x in rows], True)
                begin = end
            held = [x[begin:] for x in rows]
            if len(held[0]) > crowded or len(held[0]) and held[0][0] == many:  # it goes on: its rows need not be held
                yield from out(held, False)
                held = [x[:0] for x in held]
        yield from out(held, True)

    return pair


def _verified(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _slices(batches, PAIRS):
            sides = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = [similar(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), similarity) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _near(similarity: float) -> Column:
    """Whether the rows (s, n, f) and (t, m, g) of a cell may be similar."""
    p, q = ratio(similarity)
    sizes = F.least("n", "m").cast("long") * q >= F.greatest("n", "m").cast("long") * p
    most = F.floor((F.col("n") + F.col("m")) * (q - p) / (q + p))
    bound = F.bit_count(embedding(F.col("f")).bitwiseXOR(embedding(F.col("g")))) <= most
    return sizes & bound & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= most)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two wide fingerprints differ, at the width of the shorter one."""
    width = 64 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


def _wide_enough(similarity: float):
    """Rows (a, b, n, x, m, y) whose wide fingerprints allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype("i8") for c in "nm")
            sides = zip(*(batch.column(c).to_pylist() for c in "xy"))
            gap = np.fromiter((apart(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in sides), "i8", len(n))
            yield batch.select(["a", "b"]).filter(pa.array(gap <= most_apart(n, m, similarity)))

    return keep


REST = "c long, k int, b int, other boolean, s long, n int, r long, w binary"


def _held_against(similarity: float, nearest: bool):
    """Pairs a, b that may be similar, of the sets of a block (other is false; they come first) with those of its cell; of each set of the block all, or the nearest alone.

    Rows come ordered by (c, k, b, other).
    """

    def prints(rows: list[dict], width: int) -> np.ndarray:
        return np.stack([folded(np.frombuffer(x["w"], "<u8"), width) for x in rows])

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("i8")) for x in (a, b)], names=["a", "b"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        key, block, seen = None, [], None

        def best() -> Iterator[pa.RecordBatch]:
            if nearest and seen is not None:
                good = seen[4] < 1 << 30
                yield from out([seen[1][good]], [seen[5][good]])

        for batch in _slices(batches, PAIRS):
            rows = batch.to_pylist()
            while rows:
                now = tuple(rows[0][x] for x in "ckb")
                if now != key:
                    yield from best()
                    key, block, seen = now, [], None
                end = next((i for i, x in enumerate(rows) if tuple(x[y] for y in "ckb") != key), len(rows))
                own, rows = rows[:end], rows[end:]
                block += [x for x in own if not x["other"]]
                width = width_of(max(1, int(GROWTH ** (key[1] - 1))))
                others = [x for x in own if x["other"] and 8 * len(x["w"]) >= width]
                if not others or not block:
                    continue
                if seen is None:
                    seen = (prints(block, width), *(np.array([x[y] for x in block], "i8") for y in "snr"), np.full(len(block), 1 << 30), np.zeros(len(block), "i8"))
                w, s, n, r, least, mate = seen
                a, b = [], []
                for x, f in zip(others, prints(others, width)):
                    gap = np.bitwise_count(w ^ f).sum(axis=1, dtype="i8")
                    hit = (r != x["r"]) & (gap <= most_apart(n, x["n"], similarity))
                    if nearest:
                        hit &= gap < least
                        least[hit], mate[hit] = gap[hit], x["s"]
                    else:
                        a.append(s[hit])
                        b.append(np.full(int(hit.sum()), x["s"]))
                yield from out(a, b)
        yield from best()

    return pair


def rest_of(members: DataFrame, wide: DataFrame, similarity: float, block: int, nearest: bool) -> DataFrame:
    """Pairs a, b of members(c, s, n, r) of one cell and different classes r that may be similar by wide(s, w); all, or of each set outside the largest class the nearest.

    The sets outside a cell's largest class are dealt into blocks of like size; every set of the cell goes to the blocks of sizes that it can be similar to.
    """
    place = F.log(F.col("n").cast("double")) / float(np.log(GROWTH))
    rows = members.join(wide, "s").withColumn("_y", place)
    largest = rows.groupBy("c", "r").count().groupBy("c").agg(F.max_by("r", F.struct("count", "r")).alias("_r"))
    strays = written(rows.join(largest, "c").where("r <> _r").drop("_r").withColumn("k", F.floor("_y").cast("int")))
    blocks = strays.groupBy("c", "k").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    strays = strays.join(blocks, ["c", "k"]).withColumn("b", F.pmod(F.xxhash64("s"), F.col("_n")).cast("int"))
    reach = F.sequence(F.floor(F.col("_y") - 1 - 1e-9).cast("int"), F.floor(F.col("_y") + 1 + 1e-9).cast("int"))
    others = rows.withColumn("k", F.explode(reach)).join(blocks, ["c", "k"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    columns = [x.split()[0] for x in REST.split(", ")]
    both = strays.withColumn("other", F.lit(False)).select(*columns).unionByName(others.withColumn("other", F.lit(True)).select(*columns))
    return both.repartition("c", "k", "b").sortWithinPartitions("c", "k", "b", "other").mapInArrow(_held_against(similarity, nearest), "a long, b long")


def by_segments(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a, b of the sets of points(s, m) whose majority fingerprints m differ in at most radius bits, by the grid of simhash.near_pairs; not all of them, but all that
    are within reach by such steps are within reach by these pairs. One set stands for those with its fingerprint, each of which is paired with it."""
    one = written(points.groupBy("m").agg(F.min("s").alias("r")))
    same = points.join(one, "m").where("s <> r").select(F.col("r").alias("a"), F.col("s").alias("b"))
    links = near_pairs(one.select(F.col("m").alias("f")), radius)
    other = links.join(one.select(F.col("m").alias("a"), F.col("r").alias("_x")), "a").join(one.select(F.col("m").alias("b"), F.col("r").alias("_y")), "b")
    return same.unionByName(other.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


def parted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs a, b those that are not of one class by classes(node, component)."""
    of = small(classes)
    met = pairs.join(of.toDF("a", "_x"), "a", "left").join(of.toDF("b", "_y"), "b", "left")
    return met.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).select("a", "b")


def crowded_cells(texts: DataFrame, shingle: int, crowded: int) -> np.ndarray:
    """Shingles to be put last, ascending, at most LAST: those of most texts, by counts of such as repeat within some thousand texts.

    A shingle of more texts than there are such portions repeats in one at least. The list decides how much work is done, not what is found.
    """
    seen = texts.mapInArrow(_repeated(shingle), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    hot = seen.where(F.col("n") > crowded).orderBy(F.desc("n"), "c").limit(LAST)
    return np.sort(np.array([r.c for r in hot.collect()], "i8").view("u8"))


def only(sets: DataFrame, pairs: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The sets that pairs a, b name, so that a join shuffles no others; all of them, if more than most would have to be sent to all executors."""
    named = written(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct())
    return sets.join(F.broadcast(named), "s", "leftsemi") if named.count() <= most else sets


def linked(sets: DataFrame, seeds: DataFrame, pairs: DataFrame, heavy: DataFrame, similarity: float, leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """node and component of linked sets: by the seeds that are similar, by the pairs of different classes that are, and by such links in the crowded cells heavy(c, s, n, f) as
    join the same classes as all would.

    sets(s, n, w, held): sizes, wide fingerprints and shingles.
    """

    def verified(found: DataFrame) -> DataFrame:
        found = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        some = only(sets, found)
        met = found.join(some.select(F.col("s").alias("a"), "n", F.col("w").alias("x")), "a").join(some.select(F.col("s").alias("b"), F.col("n").alias("m"), F.col("w").alias("y")), "b")
        near = written(met.mapInArrow(_wide_enough(similarity), "a long, b long"))
        released(found)
        some = only(sets, near)
        met = near.join(some.select(F.col("s").alias("a"), F.col("held").alias("x")), "a").join(some.select(F.col("s").alias("b"), F.col("held").alias("y")), "b")
        return written(met.mapInArrow(_verified(similarity), "a long, b long"))

    def joined(classes: DataFrame, fresh: DataFrame) -> DataFrame:
        return written(connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh)))

    classes = written(connected_components(verified(seeds)))
    classes = joined(classes, verified(parted(pairs, classes)))
    near = _near(similarity)
    turn, nearest = 0, True
    while not heavy.isEmpty():
        looked, alone = heavy, turn < min(ALONE, leaders)
        if alone:
            own = heavy.groupBy("s").agg(F.min_by("c", F.xxhash64("c", F.lit(turn))).alias("c"))
            looked = heavy.join(own, ["s", "c"]).select("c", "s", "n", "f")
        members = written(looked.join(classes, looked.s == classes.node, "left").select("c", "s", "n", "f", F.coalesce("component", "s").alias("r")))
        first = F.min_by(F.struct("s", "n", "f", "r"), F.xxhash64("s", F.lit(turn)))
        mixed = written(members.groupBy("c").agg(first.alias("l"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("c", "l"))
        led, turn = turn < leaders, turn + 1
        if mixed.isEmpty():
            if alone:
                continue
            break
        if led:
            other = mixed.select("c", F.col("l.s").alias("t"), F.col("l.n").alias("m"), F.col("l.f").alias("g"), F.col("l.r").alias("q"))
            met = members.join(other, "c").where("r <> q").where(near).select(F.col("s").alias("a"), F.col("t").alias("b"))
        else:
            met = rest_of(members.join(mixed.select("c"), "c", "leftsemi").drop("f"), sets.select("s", "w"), similarity, block, nearest)
        fresh = verified(met)
        released(members, mixed)
        if not fresh.isEmpty():
            classes = joined(classes, fresh)
        if not led and not nearest:
            break  # every pair has been looked at
        nearest = led or not fresh.isEmpty()
    return classes


def classes_of(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowded: int = CROWDED, leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """_a, _b and class of every row of docs(_a, _b, text); (_a, _b) names a text. Texts with the same shingles are of one class.

    A null text counts as empty; empty texts are of one class. Repeated names keep a row each. An empty table gives an empty one.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _classes(docs, shingle, similarity, crowded, leaders, block)


def _classes(docs: DataFrame, shingle: int, similarity: float, crowded: int, leaders: int, block: int) -> DataFrame:
    texts = docs.select("_a", "_b", text_or_empty().cast("binary").alias("b"))
    last = crowded_cells(texts, shingle, crowded)
    found = written(texts.mapInArrow(_sketch(shingle, similarity, last), SKETCH))
    least = F.min_by(F.struct("_a", "_b", "n", "f", "m", "w", "cells", "late"), F.struct("_a", "_b"))
    one = written(found.groupBy("s").agg(least.alias("_r")).select("s", "_r.*"))
    names = written(found.select("_a", "_b", "s"))
    released(found)
    seeds = written(by_segments(one.select("s", "m")))
    light = one.select(F.posexplode("cells").alias("at", "c"), "s", "n", "f").select(*CELL)
    met = written(light.repartition("c").sortWithinPartitions("c").mapInArrow(_paired(similarity, crowded), "c long, a long, b long, n int, f long"))
    pairs = met.where("b is not null").select("a", "b")
    heavy = one.select(F.explode("late").alias("c"), "s", "n", "f").unionByName(met.where("b is null").select("c", F.col("a").alias("s"), "n", "f"))
    twins = heavy.groupBy("c").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y")).where("n > 1")
    shared = written(twins.groupBy("n", "x", "y").agg(F.min("c").alias("c")).select("c"))
    heavy = written(heavy.join(shared, "c"))
    asked = seeds.unionByName(pairs)
    asked = written(asked.select(F.col("a").alias("s")).union(asked.select("b")).union(heavy.select("s")).distinct())
    asked = small(written(asked.join(one.select("s", "_a", "_b"), "s")))
    sets = texts.join(asked, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("s", "b")
    sets = written(sets.mapInArrow(_sets(shingle), "s long, n int, w binary, held binary"))
    released(one)
    joined = linked(sets, seeds, pairs, heavy, similarity, leaders, block)
    return names.join(joined, names.s == joined.node, "left").select("_a", "_b", F.coalesce("component", "s").alias("class"))
