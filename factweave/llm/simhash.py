"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Search. A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such points is at most
the number of differing bits, so linked fingerprints lie within the radius of each other. At that distance no more than `radius` of the 32
coordinates differ: with the coordinates in more blocks than that, all but `radius` of the blocks are equal. So each point goes to the grid cells
of all such choices of blocks, cells are joined, pairs beyond the Manhattan distance go, and the rest is verified on the bits. The number of
blocks follows from the number of points, so that a cell of the grid has more possible values than there are points.

Counts are written in unary (0: 00, 1: 01, 2: 11), which makes the distance the number of differing bits of the written form.

Points of cells that stay crowded (more than CROWDED of them: large groups of near copies) go to finer cells, as long as there are any. What crowds the finest
too is not paired but linked through hubs: two fingerprints differ in at most two bits if and only if some value differs from each in at
most one. A hub has 65 members at most, all of them linked, so one link from each to the smallest keeps every class whole. Hubs know radius 2 only;
at another radius the finest cells are paired whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, written
from factweave.llm.components import connected_components

RADIUS = 2
SHINGLE = 3
CROWDED = 32
LOW_BITS = 0x5555555555555555
SEED = 42
SEGMENTS = 32
SPREAD = 1.5  # bits that one count holds, about
FINER = (2, 3, 4, 6, 10)  # blocks beyond the radius, of ever finer grids
ROWS = 1 << 16  # hashes whose bits are counted at a time


def majority(hashes: np.ndarray) -> int:
    """Signed fingerprint of 64-bit hashes: a bit is set if it is in over half of them."""
    bits = np.zeros(64, "int64")
    for i in range(0, len(hashes), ROWS):
        part = hashes[i : i + ROWS]
        bits += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: words of ASCII lower-cased text, shingles with repeats; a bit is set if it is in over half of their hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only the six ASCII spaces part words
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], SEED) for s, e in zip([0, *ends[: n - 1]], [x - 1 for x in ends[min(len(words), shingle) - 1 :]])]
    return majority(np.array(hashes, "<u8"))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(x, shingle) for x in batch], dtype="int64")

    return make(text)


def embedding(f: Column) -> Column:
    """The counts of the 32 segments in unary, packed into a long."""
    low, high = f.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(f, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid(blocks: int, radius: int) -> list[int]:
    """Masks of an embedded point, one for each choice of blocks that may differ; the others name the cell."""
    cuts = [2 * (SEGMENTS * k // blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [(1 << 64) - 1 - sum(block[i] for i in away) for away in combinations(range(blocks), radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grids(radius: int, points: int) -> list[int]:
    """Numbers of blocks, ever finer: from the coarsest whose cells have more values than there are points."""
    sizes = [radius + k for k in FINER if radius + k <= SEGMENTS]
    wide = [b for b in sizes if 2 ** (SPREAD * SEGMENTS * (b - radius) / b) > points]
    return wide or sizes[-1:]


def _cells(points: DataFrame, blocks: int, radius: int) -> DataFrame:
    """cell, key, f, e of each point in each of its cells that holds another, with the cell's count."""
    e = embedding(F.col("f"))
    cells = F.array(*[F.struct(F.lit(n).alias("cell"), e.bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(grid(blocks, radius))])
    cells = points.select("f", e.alias("e"), F.explode(cells).alias("c")).select("c.cell", "c.key", "f", "e")
    shared = written(cells.groupBy("cell", "key").count().where("count > 1"))
    return written(cells.join(shared, ["cell", "key"]))


def near_pairs(points: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Links a, b between the distinct fingerprints f of points: every pair within radius; of points that crowd the finest cells, links that join the same classes."""
    pairs = None
    levels = grids(radius, points.count())
    for blocks in levels:
        held = _cells(points, blocks, radius)
        finest = blocks == levels[-1]
        light = held if finest and radius != 2 else held.where(F.col("count") <= crowded)
        other = light.select("cell", "key", F.col("f").alias("g"), F.col("e").alias("h"))
        met = light.join(other, ["cell", "key"]).where("f < g").where(F.bit_count(F.col("e").bitwiseXOR(F.col("h"))) <= radius)
        met = met.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius).select(F.col("f").alias("a"), F.col("g").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
        points = written(held.where(F.col("count") > crowded).select("f").distinct())
        if finest or points.isEmpty():
            break
    if radius != 2:
        return pairs.distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)])
    hubs = points.select("f", F.explode(F.transform(flips, lambda b: F.col("f").bitwiseXOR(b))).alias("hub"))
    first = hubs.groupBy("hub").agg(F.min("f").alias("a"), F.max("f").alias("z")).where("a < z").select("hub", "a")
    stars = hubs.join(first, "hub").where("a < f").select("a", F.col("f").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns keep), fingerprint and component_id of every row: the smallest doc_id that links lead to, its own included.
    class_fingerprint names the class by one of its fingerprints, also where it has no id.

    A null text has no words, as an empty one; such rows share fingerprint zero. A null doc_id keeps its row; its class is null only if no
    row of it has an id. Repeated rows and ids keep a result each. Columns of other names pass through keep.
    """
    row, columns = carried(keep, "fingerprint", "component_id", "class_fingerprint")
    rows = written(docs.select(row, F.col("doc_id").alias("_id"), fingerprint(text_or_empty(), shingle).alias("f")))
    points = written(rows.groupBy("f").agg(F.min("_id").alias("_id")))
    found = connected_components(near_pairs(points))
    found = written(found)
    rooted = points.join(found, points.f == found.node, "left").select("f", "_id", F.coalesce("component", "f").alias("_root"))
    rooted = written(rooted)
    least = written(rooted.groupBy("_root").agg(F.min("_id").alias("component_id")))
    classes = written(rooted.select("f", "_root").join(least, "_root").select("f", "_root", "component_id"))
    out = rows.join(classes, "f")
    return out.select(*columns, _digits("f").alias("fingerprint"), "component_id", _digits("_root").alias("class_fingerprint"))


def _digits(f: str) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))
