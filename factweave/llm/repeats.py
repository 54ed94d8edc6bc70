"""Repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else.

A string of LENGTH bytes always holds the same anchor wherever it stands: of its GRAM-byte parts the one of least hash, the first of
equals. So strings are compared only at equal anchors, and each anchor speaks for the run of strings that share it: its stretch.

1. Anchors and stretches of all texts (one for about every 170 bytes), as rows of a few numbers.
2. Stretches that occur twice or more in full are repeats; they are counted by hash, with partial sums.
3. Anchors with two or more different stretches are compared exactly. The stretches of one anchor are an enhanced suffix array: their right sides in
   order, with common prefix lengths, whose interval tree a stack scan visits. In each interval the left sides are ordered and scanned likewise: an
   interval in which both the left and the right extensions differ is a maximal repeat, with all its occurrences.
4. Anchors with more than CROWDED different stretches (the edge of a passage in very many documents) are not gathered. Their stretches are cut
   at the same places, and the parts are counted by hash (128 bits) across the cluster; only parts that recur in part are cut finer, at last into
   single strings. That finds the same strings.
5. Maximal repeats of any length are those of neighbouring anchors put together, where they have the same occurrences (repeat_groups).

Rows: a null text counts as empty; texts shorter than LENGTH lose nothing. Texts that occur twice lose all of their strings. Rows that repeat in full
keep a result each. Other columns pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, written

LENGTH = 400
GRAM = 64
CROWDED = 256
BLOCK = 1 << 18  # strings looked at together; the lowest 20 bits of a sort key hold their place
PLACE = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15  # an odd multiplier
SHUFFLE = np.uint64(0xD6E8FEB86659FD93)
RING = np.uint64((1 << 61) - 1)  # running sums are kept modulo 2^61, so that their differences are longs


# --- anchors --------------------------------------------------------------------------------------------------------


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    make = lambda b: np.concatenate((np.ones(1, "u8"), np.cumprod(np.full(n, b, "u8"))))
    return make(BASE), make(pow(BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each part of gram bytes, from running sums."""
    up, down = _powers(BLOCK + 4096 if len(data) <= BLOCK + 4096 else len(data))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * down[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= SHUFFLE
    return h ^ h >> np.uint64(29)


def sliding_minimum(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours, from running minima to the right and to the left within blocks of that width."""
    n = len(keys) - wide + 1
    rows = np.full(-(-len(keys) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, wide)
    right = np.minimum.accumulate(rows, axis=1).reshape(-1)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[wide - 1 : wide - 1 + n])


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last start of the strings that share an anchor, the anchor's place, and its hash; in order, covering all strings."""
    parts: list[tuple] = []
    raw = np.frombuffer(data, "u1")
    for begin in range(0, len(data) - length + 1, BLOCK):
        n = min(BLOCK, len(data) - length + 1 - begin)
        h = gram_hashes(raw[begin : begin + n + length - 1], gram)
        keys = (h & ~PLACE) | np.arange(len(h), dtype="u8")
        least = (sliding_minimum(keys, length - gram + 1) & PLACE).astype("int64")
        first = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1))
        last = np.append(first[1:] - 1, n - 1)
        parts.append((first + begin, last + begin, least[first] + begin, h[least[first]].view("i8")))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, "i8") for _ in range(4))


# --- the interval tree of one anchor ----------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, "u1", n) != np.frombuffer(b, "u1", n)).argmax())


def intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of two or more of n ordered strings; lcp[i] is that of strings i and i + 1. A stack holds the open ones."""
    stack: list[list[int]] = []
    for i in range(n):
        depth, first = (lcp[i] if i < n - 1 else -1), i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append([depth, first])


def ordered(strings: list[bytes]) -> tuple[list[int], list[int]]:
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of each maximal repeat of at least `length` bytes around an anchor.

    lefts are reversed. A pair of intervals is maximal if its members neither all continue alike to the right nor all to the left; strings that
    end there continue in no way.
    """
    order, lcp = ordered(rights)
    far = max(map(len, lefts))
    for right, first, last in intervals(lcp, len(order)):
        if right + far < length:
            continue
        inner = order[first : last + 1]
        left_order, left_lcp = ordered([lefts[m] for m in inner])
        for left, a, b in intervals(left_lcp, len(inner)):
            if left + right < length:
                continue
            members = [inner[m] for m in left_order[a : b + 1]]
            following = {rights[m][right : right + 1] for m in members}
            if len(following) > 1 or following == {b""}:  # left extensions differ, or end, by the interval's making
                yield left, right, members


def repeated_starts(found: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of each stretch (its anchor's place in it, its bytes), the ranges of starts of strings that another stretch holds too."""
    lefts, rights = [s[:at][::-1] for at, s in found], [s[at:] for at, s in found]
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    for left, right, members in maximal_repeats(lefts, rights, length):
        for m in members:
            at = found[m][0]
            out[m].append((at - left, at + right - length))
    return out


# --- Spark ------------------------------------------------------------------------------------------------------------

ANCHORS = "d long, e long, lo int, hi int, at int, k long, t long, before long, after long"
NEEDS = "k long, t long, n long, d long, e long, lo int, at int, crowd long, s binary"
RANGES = "d long, e long, lo int, hi int"


def _anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("d", pa.int64()), ("e", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("k", pa.int64()), ("t", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])
        for batch in batches:
            counts, parts, digests, sums = [], [], [], []
            for data in batch.column("b").to_pylist():
                lo, hi, at, k = stretches(data, length, gram)
                counts.append(len(lo))
                parts.append((lo, hi, at - lo, k))
                t = np.array([xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())], "u8")
                digests.append(t)
                sums.append(np.cumsum(t * SHUFFLE ^ k.view("u8")))
            if not digests:
                continue
            t, after = np.concatenate(digests), np.concatenate(sums)
            columns = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("d", "e")] + [np.concatenate(x) for x in zip(*parts)]
            columns += [t.view("i8"), (after - (t * SHUFFLE ^ columns[-1].view("u8")) & RING).view("i8"), (after & RING).view("i8")]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(columns, schema)], schema=schema)

    return find


def _cut(length: int):
    """Bytes of the stretches that are asked for, from their texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "t", "n", "d", "e", "lo", "at", "crowd", "s"]
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for data, d, e, asked in zip(*(batch.column(c).to_pylist() for c in ("b", "d", "e", "asked"))):
                rows += [(a["k"], a["t"], a["n"], d, e, a["lo"], a["at"], a["crowd"], data[a["lo"] : a["hi"] + length]) for a in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return cut


def _by_anchor(make, names: list[str], types: list[pa.DataType]):
    """Runs make over the stretches of one anchor after the other; rows (k, t, n, d, e, lo, at, s) come ordered by anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "n", "d", "e", "lo", "at", "s"))):
                if held and held[0][0] != row[0]:
                    rows += make(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            if rows:
                yield table(rows)
        if len(held) > 1 and (rows := make(held)):
            yield table(rows)

    return scan


def _scan(length: int):
    """Ranges of repeated starts of stretches that occur once."""

    def ranges(held: list[tuple]) -> list[tuple]:
        found = repeated_starts([(r[6], r[7]) for r in held], length)
        return [(r[3], r[4], r[5] + a, r[5] + b) for r, each in zip(held, found) if r[2] == 1 for a, b in each]

    return _by_anchor(ranges, ["d", "e", "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


GROUPS = "k long, t long, g long, begin int, n_bytes int"


def _groups(length: int):
    """Members of each maximal repeat around an anchor: their stretches, and where the repeat begins from the anchor."""

    def groups(held: list[tuple]) -> list[tuple]:
        import xxhash

        out = []
        for left, right, members in maximal_repeats([r[7][: r[6]][::-1] for r in held], [r[7][r[6] :] for r in held], length):
            at, s = held[members[0]][6:]
            name = _signed(xxhash.xxh3_64_intdigest(s[at - left : at + right], 1))
            out += [(held[m][0], held[m][1], name, -left, left + right) for m in members]
        return out

    return _by_anchor(groups, [c.split()[0] for c in GROUPS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])


STEPS = (32, 4, 1)  # strings of crowded anchors are taken by so many neighbours at first, then fewer
PARTS = "k long, t long, n long, d long, e long, lo int, at int, first int, last int, up binary, x binary, y binary"


def _parts(length: int, step: int):
    """Stretches cut at places counted from the anchor into parts of `step` strings, within ranges of starts if there are any.

    x is the hash of the bytes that all strings of an uncut part share, y that of all bytes of the part; up is y of the part that is cut finer.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [c.split()[0] for c in PARTS.split(", ")]
        types = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.binary()] * 3
        for batch in batches:
            rows = []
            for *head, lo, at, s, ranges in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "n", "d", "e", "lo", "at", "s", "ranges"))):
                for r in ranges or [{"a": 0, "b": len(s) - length, "up": None}]:
                    begin = r["a"]
                    while begin <= r["b"]:
                        low = begin - (begin - at) % step  # where the part begins if it is not cut
                        last = min(low + step - 1, r["b"])
                        shared = s[low + step - 1 : low + length]
                        rows.append((*head, lo, at, begin, last, r["up"], xxhash.xxh3_128_digest(shared), xxhash.xxh3_128_digest(s[begin : last + length])))
                        begin = last + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return split


def crowded_parts(pieces: DataFrame, length: int, steps: tuple[int, ...] = STEPS) -> Iterator[DataFrame]:
    """Parts of stretches that meet at crowded anchors, with the number c of kinds that hold each in full, without gathering an anchor's stretches; ever finer ones.

    A part whose bytes recur in full is repeated; one whose shared bytes don't recur has no repeated string; what lies between is cut finer.
    One of equal parts stands for all of them.
    """
    asked = pieces.withColumn("ranges", F.lit(None).cast("array<struct<a:int,b:int,up:binary>>"))
    for step in steps:
        parts = written(asked.select("k", "t", "n", "d", "e", "lo", "at", "s", "ranges").mapInArrow(_parts(length, step), PARTS))
        kinds = written(parts.groupBy("x", "y").agg(F.count("*").alias("c"), F.min(F.struct("k", "t")).alias("one")))
        shared = written(kinds.groupBy("x").agg(F.count("*").alias("kinds"), F.sum("c").alias("all")).where("all > 1").select("x", "kinds"))
        parts = written(parts.join(written(kinds.join(shared, "x")), ["x", "y"]))
        yield parts
        if step == steps[-1]:
            break
        finer = parts.where((F.col("kinds") > 1) & ((F.col("c") == 1) | (F.col("one") == F.struct("k", "t"))))
        finer = finer.groupBy("k", "t").agg(F.collect_list(F.struct(F.col("first").alias("a"), F.col("last").alias("b"), F.col("y").alias("up"))).alias("ranges"))
        asked = pieces.join(written(finer), ["k", "t"])


def crowded_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated starts of stretches that meet at crowded anchors and occur once."""
    found = [p.where("c > 1 and n = 1").select("d", "e", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi")) for p in crowded_parts(pieces, length)]
    return reduce(DataFrame.unionByName, found)


def crowded_groups(pieces: DataFrame, length: int) -> DataFrame:
    """Members of each part that recurs at crowded anchors, as _groups gives them. A finer part holds for all kinds that the part above it stands for."""
    found, members = [], None
    for parts in crowded_parts(pieces, length):
        rows = parts.select("k", "t", "up", "y", "c", (F.col("first") - F.col("at")).alias("begin"), (F.col("last") - F.col("first") + length).cast("int").alias("n_bytes"))
        if members is not None:
            above = members.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("y").alias("up"))
            rows = rows.drop("k", "t").join(above, "up").select(F.col("_k").alias("k"), F.col("_t").alias("t"), "up", "y", "c", "begin", "n_bytes")
        members = written(rows.distinct())
        found.append(members.where("c > 1").select("k", "t", F.xxhash64("y", "n_bytes").alias("g"), "begin", "n_bytes"))
    return reduce(DataFrame.unionByName, found)


def compared(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Of texts(d, e, b): the stretches that may hold a repeat, with their number n and their anchor's number of kinds, crowd; and the bytes of one of each kind at mixed anchors."""
    anchors = written(texts.where(F.octet_length("b") >= length).mapInArrow(_anchors(length, gram), ANCHORS))
    kinds = written(anchors.groupBy("k", "t").agg(F.count("*").alias("n")))
    crowds = written(kinds.groupBy("k").agg(F.count("*").alias("crowd"), F.sum("n").alias("all")).where("all > 1").select("k", "crowd"))
    kinds = written(kinds.join(crowds, "k"))
    seen = written(anchors.join(kinds, ["k", "t"]))
    mixed = seen.where("crowd > 1")
    # One occurrence of each different stretch: the smallest by place.
    once = mixed.where("n = 1").select("k", "t", "n", "d", "e", "lo", "hi", "at", "crowd")
    more = mixed.where("n > 1").groupBy("k", "t", "n", "crowd").agg(F.min(F.struct("d", "e", "lo", "hi", "at")).alias("_r")).select("k", "t", "n", "_r.*", "crowd")
    asked = once.unionByName(more).groupBy("d", "e").agg(F.collect_set(F.struct("k", "t", "n", "lo", "hi", "at", "crowd")).alias("asked"))
    return seen, written(texts.join(written(asked), ["d", "e"]).mapInArrow(_cut(length), NEEDS).dropDuplicates(["k", "t"]))


def _in_order(pieces: DataFrame, crowded: int) -> DataFrame:
    light = pieces.where(F.col("crowd") <= crowded).select("k", "t", "n", "d", "e", "lo", "at", "s")
    return light.repartition("k").sortWithinPartitions("k")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """d, e, lo, hi: ranges of starts of repeated strings, of texts(d, e, b); (d, e) names a text and is the same for rows that repeat in full."""
    seen, pieces = compared(texts, length, gram)
    light = _in_order(pieces, crowded).mapInArrow(_scan(length), RANGES)
    heavy = pieces.where(F.col("crowd") > crowded)
    found = seen.where("n > 1").select("d", "e", "lo", "hi").unionByName(light)
    return found if heavy.isEmpty() else found.unionByName(crowded_ranges(heavy, length))


def occurrences(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """k, g, n, d, e, start, lo, hi, before, after: the occurrences of each maximal repeat (k, g) of n bytes within the stretches of an anchor.

    lo and hi are those of the stretch that holds the repeat, before and after running sums over the stretches of the text without and with it.
    """
    seen, pieces = compared(texts, length, gram)
    groups = _in_order(pieces, crowded).mapInArrow(_groups(length), GROUPS)
    heavy = pieces.where(F.col("crowd") > crowded)
    if not heavy.isEmpty():
        groups = groups.unionByName(crowded_groups(heavy, length))
    place = ["d", "e", (F.col("lo") + F.col("at") + F.col("begin")).alias("start"), "lo", "hi", "before", "after"]
    part = seen.join(written(groups.distinct()), ["k", "t"]).select("k", "g", F.col("n_bytes").alias("n"), *place)
    whole = seen.where("n > 1").select("k", F.col("t").alias("g"), (F.col("hi") - F.col("lo") + length).alias("n"), "d", "e", F.col("lo").alias("start"), "lo", "hi", "before", "after")
    return written(part.unionByName(whole).distinct())


def repeat_groups(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """d, e, start, n_bytes and repeat (a name) of all occurrences of each maximal repeat of texts(d, e, b), of any length.

    The repeats of neighbouring anchors are one if they occur at the same places, a fixed number of bytes apart, and either overlap, if need be by the rest of
    their stretches where that is equal at all these places, or have stretches between them that are. (A repeat reaches beyond all starts of its own stretch, so
    it meets the next stretch.) Places are compared from the first one on, as a hash of all; so groups are never gathered.
    """
    found = occurrences(texts, length, gram, crowded)
    key = ["k", "g", "n"]
    first = written(found.groupBy(*key).agg(F.min(F.struct("d", "e", "start", "lo", "hi", "before", "after")).alias("f"), F.count("*").alias("c")))
    from_first = [F.col("d"), F.col("e"), F.col("start") - F.col("f.start")]
    beyond = lambda side: F.pmod(F.col(side) - F.col(f"f.{side}"), F.lit(1 << 61))
    sums = [F.bit_xor(F.xxhash64(*from_first, *more)).alias(name) for name, more in (("places", []), ("left", [beyond("before")]), ("right", [beyond("after")]))]
    nodes = written(found.join(first, key).groupBy(*key).agg(F.first("f").alias("f"), F.first("c").alias("c"), *sums))
    nodes = nodes.where("c > 1").select(*key, "f.d", "f.e", "f.start", "f.lo", "f.hi", "c", "places", "left", "right", (F.col("f.start") + F.col("n")).alias("end"))
    equal = F.col("left") == F.col("right")  # the whole stretch is, at all places
    nodes = nodes.withColumn("near", F.when(equal, F.col("lo")).otherwise(F.col("start"))).withColumn("far", F.when(equal, F.col("hi") + length).otherwise(F.col("end")))
    alike = Window.partitionBy("d", "e", "c", "places").orderBy("start", F.desc("end"), *key)
    reach = F.max("far").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    between = (F.col("lo") > F.lag("hi").over(alike) + 1) & (F.col("left") == F.lag("right").over(alike))
    goes_on = (F.col("near") <= reach) | between
    nodes = nodes.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(alike.rowsBetween(Window.unboundedPreceding, 0)))
    whole = nodes.groupBy("d", "e", "c", "places", "_run").agg(F.min_by(F.struct(*key), F.struct("start", -F.col("end"), *key)).alias("_h"), F.max("c").alias("members"), F.min("start").alias("_from"), F.max("end").alias("_to"), F.min("near").alias("_near"), F.max("far").alias("_far"), F.min_by("lo", "start").alias("_lo"), F.max_by("hi", "end").alias("_hi"))
    # A repeat that reaches the edge of its stretches may go on in a larger group.
    at_left, at_right = F.col("_from") == F.col("_lo"), F.col("_to") == F.col("_hi") + length
    whole = written(whole.select("_h.*", "members", (F.col("_to") - F.col("_from")).cast("int").alias("n_bytes"), at_left.alias("at_left"), at_right.alias("at_right")))
    name = F.lower(F.concat_ws("-", F.hex("k"), F.hex("g"), F.hex("n_bytes")))
    return prolonged(written(found.join(whole, key).select("d", "e", "start", "n_bytes", name.alias("repeat"), "members", "at_left", "at_right")))


CELL = 4096  # bytes of a text within which groups are looked for together


def prolonged(rows: DataFrame) -> DataFrame:
    """Lengthens each group by the groups that overlap its edge wherever it occurs, as far as that goes."""
    step = lambda c: F.floor(F.col(c) / CELL)
    while True:
        cover = rows.select("d", "e", F.col("repeat").alias("other"), F.col("start").alias("s"), (F.col("start") + F.col("n_bytes")).alias("z"), F.explode(F.sequence(step("start"), F.floor((F.col("start") + F.col("n_bytes")) / CELL))).alias("cell"))
        edges = F.array(*[F.when(F.col(flag), F.struct(F.lit(right).alias("right"), at.alias("at"))) for right, flag, at in ((False, "at_left", F.col("start")), (True, "at_right", F.col("start") + F.col("n_bytes")))])
        asked = rows.select("d", "e", "repeat", "members", "start", F.explode(F.array_compact(edges)).alias("_e")).select("d", "e", "repeat", "members", "start", "_e.*").withColumn("cell", step("at"))
        met = asked.join(cover, ["d", "e", "cell"]).where((F.col("s") <= F.col("at")) & (F.col("at") <= F.col("z")) & F.when(F.col("right"), F.col("z") > F.col("at")).otherwise(F.col("s") < F.col("at")))
        met = met.groupBy("repeat", "members", "right", "other", (F.col("s") - F.col("start")).alias("_shift")).agg(F.count("*").alias("c"), F.min(F.when(F.col("right"), F.col("z") - F.col("at")).otherwise(F.col("at") - F.col("s"))).alias("more"))
        more = written(met.where("c = members").groupBy("repeat").agg(F.max(F.when(~F.col("right"), F.col("more"))).alias("l"), F.max(F.when(F.col("right"), F.col("more"))).alias("r")).na.fill(0))
        if more.isEmpty():
            break
        rows = rows.join(more, "repeat", "left").na.fill(0, ["l", "r"])
        rows = written(rows.select("d", "e", (F.col("start") - F.col("l")).cast("int").alias("start"), (F.col("n_bytes") + F.col("l") + F.col("r")).cast("int").alias("n_bytes"), "repeat", "members", (F.col("l") > 0).alias("at_left"), (F.col("r") > 0).alias("at_right")))
    return rows.select("d", "e", "start", "n_bytes", "repeat")


def runs(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Bytes that ranges of starts cover, as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def kept(data: Column, ranges: Column, length: int = LENGTH) -> Column:
    """Of each text, the runs removed and what is left."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import hashlib

        for texts, found in batches:
            rows = []
            for b, r in zip(texts, found):
                b, spans, at, left = bytes(b), runs([] if r is None else r, length), 0, []
                for begin, end in spans:
                    left.append(b[at:begin])
                    at = end
                rest = b"".join([*left, b[at:]])
                rows.append((len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, rest.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])

    return cut(data, ranges)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED, with_text: bool = False) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named), n_bytes, n_removed, n_spans and kept_sha256 of every row.

    with_text adds kept, the bytes that are left, and text, the same as a string, in which bytes of a character that was cut are replacement signs.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "text"] if with_text else [])]
    row, out = carried(keep, *own)
    text, name = text_or_empty(), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    rows = docs.select(row, F.xxhash64(name, text).alias("d"), F.xxhash64(F.lit(1), text, name).alias("e"), text.cast("binary").alias("b"))
    found = repeated_ranges(rows.select("d", "e", "b"), length, gram, crowded)
    found = written(found.groupBy("d", "e").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    cut = rows.join(found, ["d", "e"], "left").select("_row", kept(F.col("b"), F.col("ranges"), length).alias("_k"))
    return cut.select(*out, *[f"_k.{c}" for c in own])
