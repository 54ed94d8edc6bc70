"""Joins of markers to facts: exact, by prefix, by owning package; and longest-prefix lookups as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import ancestors


def exact(binds: DataFrame, facts: DataFrame) -> DataFrame:
    """binds(marker, raw) with the fact of that id, or null."""
    return binds.join(facts, binds.raw == facts.id, "left")


def by_prefix(binds: DataFrame, facts: DataFrame) -> DataFrame:
    """binds(marker, prefix) with every fact whose id starts with the prefix.

    Ids are cut to the different lengths that prefixes have, so that whole prefixes meet by equality and no key holds more than its prefix's own facts. The lengths are as many as the
    longest prefix has characters at most.
    """
    sizes = [r.n for r in binds.where("prefix is not null").select(F.length("prefix").alias("n")).distinct().collect()]
    cuts = F.array(*[F.when(F.length("id") >= n, F.substring("id", 1, n)) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    keyed = facts.withColumn("_k", F.explode(F.array_compact(cuts)))
    return binds.join(keyed, binds.prefix == keyed._k).drop("_k")


def by_package(binds: DataFrame, owned: DataFrame) -> DataFrame:
    """binds(marker, package, capability) with facts of owned(id, package, capability); an unknown package leaves a null id."""
    return binds.join(owned, ["package", "capability"], "left")


def longest_prefix(items: DataFrame, path: str, owners: DataFrame, prefix: str, ties: bool = True, order: list[Column] | None = None, mark: str = "/") -> DataFrame:
    """Each item with the owners of the longest leading part of its path; all owners of equal length, or the first by order."""
    parts = items.withColumn("_p", F.explode(F.array_distinct(ancestors(F.col(path), mark))))
    met = parts.join(owners, parts._p == owners[prefix])
    keys = [c for c in items.columns]
    best = Window.partitionBy(*keys)
    if ties:
        met = met.withColumn("_best", F.max(F.length("_p")).over(best)).where("length(_p) = _best").drop("_best")
    else:
        met = met.withColumn("_n", F.row_number().over(best.orderBy(F.desc(F.length("_p")), *(order or [])))).where("_n = 1").drop("_n")
    return met.drop("_p")


def inherited(regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """regions(id) with the anchor(anchor_id, ...) of the longest dotted prefix of its id."""
    return longest_prefix(regions, "id", anchors, "anchor_id", ties=False, order=[F.col("anchor_id")], mark=".")


def unclaimed(facts: DataFrame, claimed: DataFrame, on: list[str]) -> DataFrame:
    """Facts for which no better source has the same key."""
    return facts.join(claimed, on, "left_anti")
