"""Rows derived from facts: verbs, replays, merges and choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verbs(rows: DataFrame, offered: dict[str, Column]) -> DataFrame:
    """A row for each verb whose condition holds."""
    found = F.array_compact(F.array(*[F.when(c, v) for v, c in offered.items()]))
    return rows.withColumn("verb", F.explode(found))


def replay(statements: DataFrame, key: list[str], order: list[str], op: str, create: str) -> DataFrame:
    """What is left after an ordered chain: the last statement of each key, if it creates."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return statements.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & (F.col(op) == create)).drop("_n")


def merged_services(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key, owned, ports): owned beats external, ports are united in order."""
    return rows.groupBy(*key).agg(F.max("owned").alias("owned"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"))


def merged_channels(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key, role, file): both if the roles differ, and how many files."""
    return rows.groupBy(*key).agg(F.when(F.count_distinct("role") > 1, "both").otherwise(F.min("role")).alias("role"), F.count_distinct("file").alias("files"))


def name_status(rows: DataFrame, key: list[str], flags: list[str], site: Column, n: int = 20) -> DataFrame:
    """For each key, whether any row has each flag, and its first n sites in order. No more than n sites of a key are gathered."""
    found = rows.groupBy(*key).agg(*[F.bool_or(f).alias(f) for f in flags])
    each = rows.select(*key, site.alias("_s")).where("_s is not null").distinct()
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_s"))).where(F.col("_n") <= n)
    first = first.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.array_sort(F.collect_list("_s")).alias("sites"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return found.join(first, same, "left").select(*key, *flags, F.coalesce("sites", F.array().cast(first.schema["sites"].dataType)).alias("sites"))


def first_named(files: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """For each group of files(path), the one whose name stands in names: least deep, then by place in names, then by path."""
    base = F.element_at(F.split("path", "/"), -1)
    place = F.array_position(F.array(*map(F.lit, names)), base)
    rows = files.where(base.isin(names)).withColumn("_o", F.struct(F.size(F.split("path", "/")).alias("d"), place.alias("i"), F.col("path").alias("p")))
    return rows.groupBy(*group).agg(F.min_by("path", "_o").alias("path"))


def ignored_named(files: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """group, file and reason of every other file of those names: the gaps beside first_named."""
    base = F.element_at(F.split("path", "/"), -1)
    order = Window.partitionBy(*group).orderBy(F.size(F.split("path", "/")), F.array_position(F.array(*map(F.lit, names)), base), "path")
    rows = files.where(base.isin(names)).withColumn("_n", F.row_number().over(order)).where("_n > 1")
    return rows.select(*group, F.col("path").alias("file"), F.lit("candidate-ignored").alias("reason"))


def capped_output(size: Column, factor: int = 6, least: int = 5_000_000, most: int = 256_000_000) -> Column:
    return F.least(F.greatest(size * factor, F.lit(least)), F.lit(most))


def new_contents(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest no earlier parse has."""
    return files.join(known.select("digest").distinct(), "digest", "left_anti")
