"""Globs as rows, met by paths segment by segment: a trie of glob segments joined with the trie of folders.

Both sides are tables of edges. A state is a folder or file together with a node of the globs' trie; a step joins the states with what lies in their folders and with the edges out of their
nodes, by name where a segment is plain and by pattern where it isn't. ** stays in its node. So a folder that no glob leads into is never looked into, folders that many
paths share are looked at once, and no path is compared with all globs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import ancestors
from factweave.staging import written

BRACES = r"^([^{]*)\{([^{}]*)\}(.*)$"


def plain_globs(globs: DataFrame) -> DataFrame:
    """glob and segments: choices in braces become globs of their own, ./ before and slashes at the end as they are meant (all below). Segments hold *, ? and whole **."""
    rows = globs.select("glob", F.regexp_replace(F.regexp_replace("glob", r"^\./", ""), "/$", "/**").alias("g")).distinct()
    while not rows.where(F.col("g").rlike(BRACES)).isEmpty():
        part = lambda n: F.regexp_extract("g", BRACES, n)
        opened = F.when(F.col("g").rlike(BRACES), F.transform(F.split(part(2), ",", -1), lambda c: F.concat(part(1), c, part(3)))).otherwise(F.array("g"))
        rows = written(rows.select("glob", F.explode(opened).alias("g")))
    return rows.select("glob", F.split("g", "/", -1).alias("segments")).distinct()


def segment_pattern(segment: Column) -> Column:
    quoted = F.regexp_replace(segment, r"([\\.+^$()|\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """glob and path of every match between globs(glob) and paths(path). Repeated rows count once; null and empty ones match nothing."""
    parsed = written(plain_globs(globs.where("glob <> ''")))
    node = lambda n: F.array_join(F.slice("segments", F.lit(1), n), "/")
    steps = parsed.select("glob", F.size("segments").alias("n"), F.posexplode("segments").alias("at", "segment"), "segments")
    edges = written(steps.select(node(F.col("at")).alias("node"), node(F.col("at") + 1).alias("to"), "segment").distinct())
    ends = written(parsed.select(node(F.size("segments")).alias("node"), "glob", (F.element_at("segments", -1) == "**").alias("below")).distinct())
    entries = paths.where("path <> ''").select(F.explode(ancestors(F.col("path"))).alias("entry")).distinct()
    entries = written(entries.select("entry", F.regexp_replace("entry", r"/?[^/]*$", "").alias("folder"), F.regexp_extract("entry", r"[^/]*$", 0).alias("name")))
    stays = edges.where("segment = '**'").select("node", "to")
    plain = edges.where(~F.col("segment").rlike(r"[*?]"))
    shaped = edges.where(F.col("segment").rlike(r"[*?]") & (F.col("segment") != "**")).withColumn("pattern", segment_pattern(F.col("segment")))
    anywhere = stays.select(F.col("to").alias("node")).distinct()

    def with_stars(states: DataFrame) -> DataFrame:
        """** may stand for nothing, so who is at its parent is in it too."""
        found = [states]
        while True:
            more = found[-1].join(stays, "node").select("entry", F.col("to").alias("node"), F.lit(False).alias("moved"))
            if more.isEmpty():
                return reduce(DataFrame.unionByName, found).groupBy("entry", "node").agg(F.max("moved").alias("moved"))
            found.append(written(more))

    root = globs.sparkSession.createDataFrame([("", "", False)], "entry string, node string, moved boolean")
    states, reached = written(with_stars(root)), []
    while True:
        there = states.withColumnRenamed("entry", "folder").join(entries, "folder").select("entry", "name", "node")
        there = written(there)
        by_name = there.join(plain, (there.node == plain.node) & (there.name == plain.segment)).select("entry", plain["to"].alias("node"))
        by_shape = there.join(shaped, "node").where(F.rlike("name", F.col("pattern"))).select("entry", F.col("to").alias("node"))
        by_star = there.join(anywhere, "node").select("entry", "node")
        new = by_name.unionByName(by_shape).unionByName(by_star).distinct().withColumn("moved", F.lit(True))
        states = written(with_stars(written(new)))
        if states.isEmpty():
            break
        # ** at the end asks for something below; anywhere else an end is an end.
        reached.append(states.join(ends, "node").where("moved or not below").select("glob", F.col("entry").alias("path")))
    if not reached:
        return globs.select("glob", F.lit("").alias("path")).limit(0)
    found = reduce(DataFrame.unionByName, reached).distinct()
    return found.join(paths.select("path").distinct(), "path", "left_semi").select("glob", "path")


def selected(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """set and path: of each set of globs(set, glob), where ! before a glob takes away, what some glob takes and none takes away."""
    rows = globs.select("set", F.regexp_replace("glob", "^!", "").alias("glob"), F.startswith("glob", F.lit("!")).alias("away"))
    found = rows.join(matches(paths, rows), "glob").groupBy("set", "path").agg(F.bool_or("away").alias("away"))
    return found.where("not away").select("set", "path")
