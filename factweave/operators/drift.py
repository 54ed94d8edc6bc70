"""States of documented statements against current facts, their causes, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import canon

DRIFT = ("stale", "tampered", "dead")


def state(*, snoozed: Column, failed: Column, n_missing: Column, n_tombstoned: Column, kind: Column, recorded: Column, current: Column, content: Column, body: Column, held: Column) -> Column:
    """The first state that applies, in fixed order. recorded and current: hashes of facts; content and body: of the text; held: a rejection of the current hash."""
    facts, text = canon.match(recorded, current), canon.match(content, body)
    found = F.when(F.coalesce(snoozed, F.lit(False)), "snoozed").when(F.coalesce(failed, F.lit(False)), "unresolvable")
    found = found.when((n_missing > 0) & (n_missing == n_tombstoned), "intentionally_removed").when(n_missing > 0, "dead")
    found = found.when(kind == "anchor", "clean")
    gen, refused = kind == "gen", F.coalesce(held, F.lit(False))
    found = found.when(gen & content.isNotNull() & (text == "version"), "unverified").when(gen & content.isNotNull() & (text == "differ"), F.when(refused, "held").otherwise("tampered"))
    found = found.when(recorded.isNotNull() & (facts == "version"), "unverified").when(recorded.isNotNull() & (facts == "differ"), F.when(refused, "held").otherwise("stale"))
    return found.when(gen & (content.isNull() | recorded.isNull()), "unverified").otherwise("clean")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (new, deleted or changed) of what differs between two snapshots."""
    a, b = before.select(F.col(key), F.col(value).alias("_a"), F.lit(1).alias("_in_a")), after.select(F.col(key), F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def self_caused(findings: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Adds whether a finding's fact is among those changed."""
    marked = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return findings.join(marked, key, "left").withColumn("self_caused", F.coalesce("_hit", F.lit(False))).drop("_hit")


def coverage(surfaces: DataFrame, documented: DataFrame, key: str, group: str) -> DataFrame:
    """total, documented and rounded percentage for each group, and for all under a null group."""
    known = documented.select(key).distinct().withColumn("_d", F.lit(1))
    rows = surfaces.join(known, key, "left").rollup(group).agg(F.count("*").alias("total"), F.count("_d").alias("documented"))
    return rows.withColumn("pct", F.when(F.col("total") > 0, F.floor((200 * F.col("documented") + F.col("total")) / (2 * F.col("total"))).cast("bigint")))
