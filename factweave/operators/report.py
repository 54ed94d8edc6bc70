"""Reports: ledgers, result levels, set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(channels: dict[str, tuple[DataFrame, str, bool]]) -> DataFrame:
    """channel, total and whether it is a verdict: the sum of a column of each table; then a row of all verdicts."""
    rows = [t.agg(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total")).select(F.lit(k).alias("channel"), "total", F.lit(v).alias("verdict")) for k, (t, c, v) in channels.items()]
    rows = reduce(DataFrame.unionByName, rows)
    return rows.unionByName(rows.agg(F.coalesce(F.sum(F.when(F.col("verdict"), F.col("total"))), F.lit(0)).alias("total")).select(F.lit("all verdicts").alias("channel"), "total", F.lit(True).alias("verdict")))


def sarif_level(state: Column) -> Column:
    return F.when(state.isin("dead", "tampered"), "error").when(state == "stale", "warning").when(state.isin("unverified", "unresolvable"), "note").otherwise("none")


def sarif(findings: DataFrame) -> DataFrame:
    """One JSON result for each of findings(id, doc, line, state, detail)."""
    place = F.struct(F.struct(F.struct(F.col("doc").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("state").alias("ruleId"), sarif_level(F.col("state")).alias("level"), F.struct(F.concat_ws(" ", "id", "detail").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.where(sarif_level(F.col("state")) != "none").select("id", F.to_json(result).alias("result"))


def missing_sections(recipe: DataFrame, present: DataFrame, order: str, id_: str, doc: str) -> DataFrame:
    """Sections of each document's recipe that it lacks, each with the nearest section before it that the document has."""
    have = present.select(F.col(doc), F.col(id_), F.lit(True).alias("_have")).distinct()
    rows = recipe.join(have, [doc, id_], "left")
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after_section", F.last(F.when(F.col("_have"), F.col(id_)), ignorenulls=True).over(before))
    return rows.where("_have is null").drop("_have")


def recall_precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """hits, misses and inventions of a set of keys against the truth."""
    t, f = truth.distinct(), found.distinct()
    count = lambda d, n: d.agg(F.count("*").alias(n))
    return count(t.intersect(f), "hits").crossJoin(count(t.subtract(f), "misses")).crossJoin(count(f.subtract(t), "inventions"))


def survival(seen: DataFrame, unit: str, period: str) -> DataFrame:
    """For each period, how many of the units of the first one are seen again: seen(unit, period), one row for each."""
    first = seen.agg(F.min(period).alias("_p"))
    base = seen.join(F.broadcast(first), seen[period] == first._p).select(unit)  # one row
    return seen.join(base, unit, "left_semi").groupBy(period).agg(F.count_distinct(unit).alias("survivors"))
