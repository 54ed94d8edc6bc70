"""One winner among the claims on a fact, and what the losers said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules in order; each is a column that ranks claims, smallest first.
RULES = ("pin", "lattice", "precedence", "provider")


def ranked(claims: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Adds rank, 1 for the winner; order must be total."""
    return claims.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def winners(claims: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return ranked(claims, key, order).where("rank = 1").drop("rank")


def conflicts(claims: DataFrame, key: list[str], rules: dict[str, Column], value: str) -> DataFrame:
    """For keys whose claims differ in value: winner and runner-up by the rules, and the first rule that parts them."""
    rows = claims.select(*key, value, F.struct(*[c.alias(k) for k, c in rules.items()]).alias("_order"))
    held = rows.groupBy(*key).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_claims"), F.min("_order").alias("_first"))
    both = ranked(rows, key, [F.col("_order")]).where("rank <= 2")
    pair = both.groupBy(*key).agg(F.max(F.when(F.col("rank") == 1, F.col(value))).alias("winner"), F.max(F.when(F.col("rank") == 2, F.col("_order"))).alias("_second"))
    rule = F.lit("tie")
    for name in reversed(list(rules)):
        rule = F.when(~F.col(f"_first.{name}").eqNullSafe(F.col(f"_second.{name}")), name).otherwise(rule)
    return held.where("n_values > 1").join(pair, key).select(*key, "n_values", "n_claims", "winner", rule.alias("rule"))


def conflicts_in_order(rows: DataFrame, key: str) -> DataFrame:
    """Conflicts as people read them: by key in the order of ICU, equal ones by code point."""
    return rows.orderBy(F.collate(F.col(key), "UNICODE"), key)
