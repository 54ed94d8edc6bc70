"""Dual-tree Lloyd: clusters of integer vectors around k centroids, exact to the last unit.

Vectors are cut into blocks, each with a cover tree of its own, built once and written with the block. Each round makes a cover tree of the centroids. The two trees are walked
together, level by level: a pair of nodes goes if no vector of the one can be nearest to a centroid of the other, by the distance of their centres and their radii;
a node of vectors to which one centroid is left takes it whole, and pairs of leaves are compared exactly. Bounds are floating point with room for their
error; distances, sums and means are integers.

A cover tree here: a node's centre is one of its points, and is the centre of one of its children; children lie within 2^(i-1) of the centre that covers them and farther
than that from each other, where 2^i is the first power of two not below the node's radius. Points that are equal are one leaf.

Only centroids pass through the driver: k * dims numbers, at most MOST of them. Tasks add up their vectors before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import carried, written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
BLOCK = 512  # vectors of one tree
PAIRS = 8192  # whose distances are computed at a time
MOST = 1 << 24  # numbers in all centroids
FLOATS = 1 << 22  # components below it have squared distances of up to 64 dimensions below 2^53, where floating point is exact
LIMIT = 1 << 27  # components beyond it could have squared distances beyond 63 bits
SLACK = 1e-9


class Tree(NamedTuple):
    """Nodes in order of levels, the root first: centre, first child and number of children, span of the points below, squared radius. Leaves have no children."""

    point: np.ndarray
    first: np.ndarray
    children: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    radius2: np.ndarray


TREE = ", ".join(f"{name} array<long>" for name in Tree._fields)


def exact_type(*arrays: np.ndarray) -> type:
    """Floating point where it is exact for these vectors, else integers."""
    widest = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    dims = max((a.shape[1] for a in arrays), default=1)
    return np.float64 if widest < FLOATS and dims <= 64 else np.int64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of equal place."""
    out = np.empty(len(a), a.dtype)
    for i in range(0, len(a), PAIRS):
        d = a[i : i + PAIRS] - b[i : i + PAIRS]
        out[i : i + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of some vectors, and the order of the vectors to which its spans refer."""
    x = points.astype(exact_type(points))
    square = np.einsum("ij,ij->i", x, x)
    apart = square[:, None] + square[None, :] - 2 * (x @ x.T)
    nodes = [(np.arange(len(x)), 0)] if len(x) else []
    order = np.empty(len(x), "i8")
    made, at = [], 0
    while at < len(nodes):
        members, begin = nodes[at]
        centre = members[0]
        far = int(apart[centre, members].max())
        made.append([centre, len(nodes), 0, begin, len(members), far])
        at += 1
        if not far:
            order[begin : begin + len(members)] = members
            continue
        level = (far - 1).bit_length()
        cover = (1 << (level + level % 2)) // 4
        while len(members):
            near = apart[members[0], members] <= cover
            nodes.append((members[near], begin))
            begin += int(near.sum())
            members = members[~near]
        made[-1][2] = len(nodes) - made[-1][1]
    columns = np.array(made, "i8").reshape(-1, 6).T
    place = np.empty(len(x), "i8")
    place[order] = np.arange(len(x))
    return Tree(place[columns[0]], *columns[1:]), order


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, count of them, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def nearest(tree: Tree, x: np.ndarray, other: Tree, c: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each of the vectors x, in the tree's order, the number of the nearest of the vectors c of the other tree; of equally near ones the smallest number.

    number(i) is the smallest number among the points of leaf i of the other tree.
    """
    label = np.empty(len(x), "i8")
    radius, reach = np.sqrt(tree.radius2.astype("f8")), np.sqrt(other.radius2.astype("f8"))
    q = k = np.zeros(1 if len(x) else 0, "i8")
    while len(q):
        turn = np.argsort(q, kind="stable")
        q, k = q[turn], k[turn]
        d2 = distances(x[tree.point[q]], c[other.point[k]])
        d = np.sqrt(d2.astype("f8"))
        new = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        most = np.repeat(np.minimum.reduceat(d + radius[q], new), np.diff(np.append(new, len(q))))
        keep = d - radius[q] - reach[k] <= most * (1 + SLACK) + SLACK
        q, k, d2 = q[keep], k[keep], d2[keep]
        new = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        count = np.diff(np.append(new, len(q)))
        inner = other.children[k] > 0
        done = (np.add.reduceat(inner.astype("i8"), new) == 0) & ((tree.children[q[new]] == 0) | (count == 1))
        settled = np.repeat(done, count)
        if settled.any():
            sq, sk, sd = q[settled], k[settled], d2[settled]
            best = np.lexsort((number[sk], sd, sq))
            best = best[np.append(True, np.diff(sq[best]) > 0)]
            label[_runs(tree.begin[sq[best]], tree.size[sq[best]])] = np.repeat(number[sk[best]], tree.size[sq[best]])
        q, k = q[~settled], k[~settled]
        # Children of both, or the node itself where it has none.
        many = np.maximum(tree.children[q], 1)
        own = np.where(tree.children[q] > 0, tree.first[q], q)
        k, q = np.repeat(k, many), _runs(own, many)
        many = np.maximum(other.children[k], 1)
        own = np.where(other.children[k] > 0, other.first[k], k)
        q, k = np.repeat(q, many), _runs(own, many)
    return label


class Centroids:
    """The tree of one round's centroids, made in each task that needs it."""

    def __init__(self, values: list[list[int]]):
        self.values = np.array(values, "i8") if values else np.zeros((0, 1), "i8")
        self.tree, order = cover_tree(self.values)
        self.sorted = self.values[order]
        leaf = np.flatnonzero(self.tree.children == 0)
        self.number = np.full(len(self.tree.point), -1)
        self.number[leaf] = np.minimum.reduceat(order[_runs(self.tree.begin[leaf], self.tree.size[leaf])], np.cumsum(self.tree.size[leaf]) - self.tree.size[leaf]) if len(leaf) else []

    def of(self, tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of each vector of a block."""
        kind = exact_type(points, self.values)
        x, c = points.astype(kind), self.sorted.astype(kind)
        label = nearest(tree, x, self.tree, c, self.number)
        return label, distances(x, self.values.astype(kind)[label]).astype("i8")


def _blocks(block: int, dims: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                points = part.column("x").flatten().to_numpy().reshape(-1, dims)
                if np.abs(points).max(initial=0) > LIMIT:
                    raise ValueError(f"a component times the scale is beyond {LIMIT}; squared distances may not fit a long")
                tree, order = cover_tree(points)
                rows = part.column("_row").take(pa.array(order))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in tree]
                data = pa.array([points[order].astype("<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), data, *lists], names=["rows", "points", *Tree._fields])

    return build


def _read(batch: pa.RecordBatch, i: int, dims: int) -> tuple[Tree, np.ndarray]:
    tree = Tree(*(batch.column(name)[i].values.to_numpy() for name in Tree._fields))
    return tree, np.frombuffer(batch.column("points")[i].as_py(), "<i4").reshape(-1, dims)


def _sums(values: list[list[int]], dims: int):
    """Of each centroid that has vectors in a task: its number, how many, and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(values)
        count, total = np.zeros(len(values), "i8"), np.zeros((len(values), dims), object)
        for batch in batches:
            for i in range(batch.num_rows):
                tree, points = _read(batch, i, dims)
                label, _ = now.of(tree, points)
                turn = np.argsort(label, kind="stable")
                which, first = np.unique(label[turn], return_index=True)
                total[which] += np.add.reduceat(points[turn].astype("i8"), first, axis=0).astype(object)
                count += np.bincount(label, minlength=len(values))
        there = np.flatnonzero(count)
        texts = [[str(v) for v in total[j]] for j in there]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(texts, pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    return add


def _labels(values: list[list[int]], dims: int):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(values)
        for batch in batches:
            found = [now.of(*_read(batch, i, dims)) for i in range(batch.num_rows)]
            ends = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]), pa.int32())
            both = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0, "i8")]).astype("i8"))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("rows"), *both], names=["rows", "cluster", "distance"])

    return label


def whole_vectors(vectors: DataFrame, column: str, dims: int, scale: int, *more: Column) -> DataFrame:
    """Rows with dims components, none null or not finite, as x: floor(scale * component)."""
    v = F.col(f"`{column}`").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = vectors.where((F.size(v) == dims) & F.forall(v, finite))
    return rows.select(*more, F.transform(v, lambda e: F.floor(e * float(scale))).alias("x"))


def cluster(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", keep: list[str] | None = None, dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """Columns keep (key alone unless named), cluster and distance (squared) of each whole vector after so many rounds, and the centroids.

    Centroids 0, 1, ... start as the k whole vectors of least SHA-256 of seed:key, in that order; of rows with one key those of least components. Each round moves every centroid
    that has vectors to the floor of their mean. Vectors that are null, of another length, or hold nulls or what is not finite are left out; a null key counts as empty text.
    Fewer than k whole vectors make as many clusters as there are; none gives an empty table. Repeated rows count and come out as often as they are.
    A component beyond LIMIT once scaled is an error, since distances would not fit a long.
    """
    if k * dims > MOST:
        raise ValueError(f"{k} centroids of {dims} components are more than {MOST} numbers")
    row, columns = carried([key] if keep is None else keep, "cluster", "distance")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    first = whole_vectors(vectors, column, dims, scale, digest.alias("h")).orderBy("h", "x").limit(k)
    values = [list(r.x) for r in first.collect()]
    rows = whole_vectors(vectors, column, dims, scale, row)
    shape = f"rows array<{rows.schema['_row'].dataType.simpleString()}>"
    blocks = written(rows.mapInArrow(_blocks(block, dims), f"{shape}, points binary, {TREE}"))
    for _ in range(rounds if values else 0):
        parts = blocks.drop("rows").mapInArrow(_sums(values, dims), "cluster int, n long, sums array<string>")
        sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        values = [list(v) for v in values]
        for r in sums.collect():  # k * dims rows at most
            values[r.cluster][r["at"]] = int(r.v) // r.n
    out = blocks.mapInArrow(_labels(values, dims), f"{shape}, cluster array<long>, distance array<long>")
    each = F.arrays_zip(F.col("rows"), F.col("cluster"), F.col("distance"))
    out = out.select(F.explode(each).alias("_e")).select(F.col("_e.rows").alias("_row"), F.col("_e.cluster").cast("int").alias("cluster"), F.col("_e.distance").alias("distance"))
    return out.select(*columns, "cluster", "distance"), values


def described(found: DataFrame, values: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia and inertia, the distances summed over the cluster and over all, and centroid_sha256, of the centroid's components joined by commas."""
    found = written(found)
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    each = each.crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia"))))
    names = found.sparkSession.createDataFrame([(n, ",".join(map(str, v))) for n, v in enumerate(values)], "cluster int, _c string")
    each = each.join(F.broadcast(names), "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("_c", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(each), "cluster").select(*found.columns, "cluster_inertia", "inertia", "centroid_sha256")
