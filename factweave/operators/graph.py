"""Closures over parent and include relations, level by level, and orders of dependent things."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.staging import written


def prefixes(roots: DataFrame, mounts: DataFrame, join: Column | None = None, limit: int | None = None) -> DataFrame:
    """node, path, depth: every path by which roots(node, path) reach a node over mounts(parent, child, part); a node is not entered twice on a path.

    Each level is a join of what the last one reached, written down; it ends when nothing new is reached, however deep or wide. join makes the new path of `path` and
    `part`, which are put together as they are unless it is given. Deeper than limit, if there is one, is an error.
    """
    edges = mounts.select(F.col("parent").alias("_parent"), F.col("child").cast("string").alias("_child"), F.col("child").alias("_node"), "part")
    name = F.col("node").cast("string")
    reach = written(roots.select("node", "path", F.lit(0).alias("depth"), F.array(name).alias("_seen")).distinct())
    levels, path = [reach], F.concat("path", "part") if join is None else join
    while True:
        step = reach.join(edges, reach.node == edges._parent).where(~F.array_contains("_seen", F.col("_child")))
        step = step.select(F.col("_node").alias("node"), path.alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("_seen", F.array("_child")).alias("_seen"))
        reach = written(step.distinct())
        if reach.isEmpty():
            return reduce(DataFrame.unionByName, levels).select("node", "path", "depth").distinct()
        if limit is not None and len(levels) > limit:
            raise ValueError(f"a path of more than {limit} steps")
        levels.append(reach)


def beginnings(links: DataFrame, most: int | None = None) -> DataFrame:
    """node and root: where the chain of links(node, parent) from each node begins. A node that is its own parent is a root; a parent that is null or no node leads nowhere: root is null.

    Pointer doubling: each round every node looks as far ahead as its parent has, so chains of n steps take log2(n) rounds on written tables. A node has one parent; circles lead nowhere. Chains of
    more than `most` steps, if it is given, lead nowhere either.
    """
    far = written(links.select("node", F.col("parent").alias("root"), (F.col("node") == F.col("parent")).cast("long").alias("_end"), (F.col("node") != F.col("parent")).cast("long").alias("_n")).where("root is not null"))
    limit = far.count()
    reached = 1
    while True:
        ahead = far.select(F.col("node").alias("root"), F.col("root").alias("_r"), F.col("_end").alias("_e"), F.col("_n").alias("_m"))
        step = far.where("_end = 0").join(ahead, "root").select("node", F.col("_r").alias("root"), F.col("_e").alias("_end"), (F.col("_n") + F.col("_m")).alias("_n"))
        far = written(far.where("_end = 1").unionByName(step))
        open_ = far.where("_end = 0")
        if open_.isEmpty() or reached > limit:
            break
        reached *= 2
    done = far.where("_end = 1") if most is None else far.where((F.col("_end") == 1) & (F.col("_n") <= most))
    return links.select("node").join(done.select("node", "root"), "node", "left")


def sweeps(names: DataFrame, needs: DataFrame) -> DataFrame:
    """name and sweep of names(name) with needs(name, need): the sweep over all names in alphabetical order in which each comes when everything it needs has come.

    Ordered by (sweep, name) they are in order of dependence. A need that is no name, or a circle, is an error.
    """
    unmet = needs.join(names, needs.need == names.name, "left_anti").select("need").first()
    if unmet:
        raise ValueError(f"nothing provides {unmet.need}")
    found = written(names.select("name", F.lit(0).alias("sweep")).distinct())
    for _ in range(found.count() + 1):
        after = needs.join(found.withColumnRenamed("name", "need"), "need").select("name", (F.col("sweep") + (F.col("need") > F.col("name")).cast("int")).alias("sweep"))
        later = written(after.unionByName(found).groupBy("name").agg(F.max("sweep").alias("sweep")))
        if later.join(found, ["name", "sweep"], "left_anti").isEmpty():
            return found
        found = later
    raise ValueError("needs run in a circle")


def fan_in(imports: DataFrame, known: DataFrame) -> DataFrame:
    """How often each known module is imported: imports(module, target), known(target)."""
    return imports.join(known, "target", "left_semi").groupBy("target").agg(F.count("*").alias("fan_in"))


def first_probe(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(id, probes array) with the first of its probes that is a path in files(path)."""
    rows = wanted.select("id", F.posexplode("probes").alias("pos", "path"))
    return rows.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "pos").alias("path"))
