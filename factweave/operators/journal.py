"""Folds over an append-only log of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], at: str, arrival: str) -> DataFrame:
    """The newest entry of each key; of equals, that which came first. Independent of the order of rows."""
    order = Window.partitionBy(*key).orderBy(F.desc(at), F.asc(arrival))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def effective(decisions: DataFrame, revokes: DataFrame, target: str, at: str, of: str | None = None) -> DataFrame:
    """Decisions (one row a target and type) that the target's latest revoke does not undo.

    Only the latest revoke of a target counts: it undoes decisions of its type `of` (any, if None) that are older.
    """
    last = revokes.groupBy(target).agg(F.max_by(F.struct("*"), at).alias("_r"))
    joined = decisions.join(last, target, "left")
    undone = F.col("_r").isNotNull() & (F.col(f"_r.{at}") > F.col(at))
    if of:
        undone &= F.col(f"_r.{of}") == F.col("type")
    return joined.where(~undone).drop("_r")


def trailing(log: DataFrame, at: Column, end: Column, days: int) -> DataFrame:
    """Entries of the days before end, end included."""
    return log.where((at > end - F.make_interval(days=F.lit(days))) & (at <= end))


def week_of(at: Column, end: Column, weeks: int = 4) -> Column:
    """0 for the oldest of the weeks that end at `end`; the newest holds the end itself. Null outside."""
    gone = F.unix_micros(at) - (F.unix_micros(end) - F.lit(weeks * 7 * 86_400_000_000))
    return F.when(gone >= 0, F.least(F.floor(gone / (7 * 86_400_000_000)), F.lit(weeks - 1)).cast("int"))
