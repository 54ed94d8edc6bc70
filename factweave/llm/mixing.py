"""Mixing sources to target weights, by whole copies and Pareto order sampling.

Targets. Sources weigh WEIGHTS in turn by code point (null last) and share SHARE of all words; a target stops at CAP times its source,
the excess going to the others by weight: level * weight for sources below their cap, where the level follows from running sums
over sources in the order in which they fill up.

Expected copies. Within a source, documents are classed by the number of binary digits of their size, and a longer class is
preferred a little (LEAN per digit). The expected copies of a class, at most CAP, are again a level times that preference, so that
expected words meet the target. Both steps work on tables of one row per source, or per source and class, never on documents.

Sampling. The whole part of the expected copies is certain. What remains is an inclusion probability p, and documents
are ranked by random odds u/(1-u) over inclusion odds p/(1-p). A source takes the ranks whose words reach the middle of the rest of its target,
so its words differ from the target by about half of a document. Ranks are added up over fine slices of their value first, then within the one slice in
which a source's sample ends, so no task sees a whole source.

Rows: a null or empty text has no words and is taken 0 times; a null source is a source of its own, after all others. Rows that repeat in full are
units of their own with equal ranks: which of them is taken doesn't show. u depends on the seed, the id and the text only, so reruns agree. Other
columns pass through `keep`. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
LEAN = 8  # a class of d binary digits is preferred as LEAN + d
SLICES = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)


def levels(table: DataFrame, group: list[str], most: str, weight: str, total: Column) -> DataFrame:
    """Adds share: weight times a common level in each group, at most `most`, so that shares make up total as far as they can."""
    by = Window.partitionBy(*group).orderBy(F.col(most) / F.col(weight), *[c for c in table.columns if c not in group])
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum(weight).over(after)
    # The first row that its level does not fill, and all after it, share that level.
    full = F.col(most) / F.col(weight) <= level
    table = table.withColumn("_level", level).withColumn("_full", full)
    first = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table.withColumn("share", F.when(first.isNull() | (F.col(most) / F.col(weight) <= first), F.col(most).cast("double")).otherwise(F.col(weight) * first)).drop("_level", "_full")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size and target from a table of (source, size). One row per source: it is ordered in a single task."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("all", F.lit(1))
    total = share * F.sum("source_size").over(Window.partitionBy("all"))
    return levels(table, ["all"], "most", "weight", total).select("source", "source_size", F.col("share").alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, slices: int | None = None) -> DataFrame:
    """Columns keep of docs (doc_id alone unless named), size, source_size, target and copies of every row.

    Ranks are cut in as many slices as the square root of the number of rows, SLICES at least; so neither the table of slices of a source nor the slice in which its
    sample ends has many more rows than that.
    """
    row, columns = carried(keep, "size", "source_size", "target", "copies")
    text = text_or_empty()
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    rows = docs.select(row, F.col("source").cast("string").alias("source"), word_count(text).alias("size"), u.alias("u"))
    rows = written(rows.withColumn("digits", F.length(F.bin("size"))))
    slices = slices or max(SLICES, math.isqrt(rows.count()))
    classes = written(rows.groupBy("source", "digits").agg(F.sum("size").alias("words")))
    targets = written(source_targets(classes.select("source", F.col("words").alias("size")), weights, share, cap))
    plan = classes.join(targets, classes.source.eqNullSafe(targets.source)).select(targets.source, "digits", "words", "source_size", "target")
    # Expected copies: level * preference in units of words, so weigh the class's words by its preference.
    plan = plan.where("words > 0").withColumn("most", cap * F.col("words")).withColumn("weight", F.col("words") * (LEAN + F.col("digits")))
    plan = levels(plan, ["source", "source_size", "target"], "most", "weight", F.col("target")).select("source", "digits", (F.col("share") / F.col("words")).alias("expected"))
    plan = written(plan.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.floor("expected")))
    # One row per source and class of sizes, of which there are at most 64: planned for broadcast only below Spark's own size limit.
    ranked = rows.join(plan, rows.source.eqNullSafe(plan.source) & (rows.digits == plan.digits), "left").select("_row", rows.source, "size", "u", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("p", F.lit(0.0)).alias("p"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) keeps the order and lies in (0, 1), so it can be cut into slices of even width.
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds))).withColumn("slice", F.floor(F.col("rank") * slices))
    ranked = written(ranked)
    parts = ranked.where("slice is not null").groupBy("source", "slice").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("p")).alias("wanted"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("rest", F.round(F.sum("wanted").over(Window.partitionBy("source")), 3))
    ends = written(parts.select("source", F.col("slice").alias("end"), "before", "rest").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))))
    placed = ranked.join(ends, ranked.source.eqNullSafe(ends.source), "left").select("_row", ranked.source, "size", "whole", "rank", "slice", "end", "before", "rest")
    order = Window.partitionBy("source").orderBy("rank", "size", F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where("slice = end").withColumn("sum", F.sum("size").over(order) + F.col("before"))
    edge = edge.withColumn("drawn", (F.col("sum") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    other = placed.where("not coalesce(slice = end, false)").withColumn("drawn", F.coalesce((F.col("slice") < F.col("end")).cast("int"), F.lit(0)))
    cols = ["_row", "source", "size", (F.col("whole") + F.col("drawn")).alias("copies")]
    out = other.select(*cols).unionByName(edge.select(*cols))
    return out.join(targets, out.source.eqNullSafe(targets.source)).select(*columns, "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies"))
