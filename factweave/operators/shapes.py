"""Shapes of facts: for each type, how rows of a provider become ids and payloads."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import without_name
from factweave.operators import normalise


class Shape(NamedTuple):
    """id: from the row; attrs: columns of the payload; sites: how many sources are kept."""

    id: Callable[[], Column]
    attrs: tuple[str, ...]
    sites: int | None = None


def _id(capability: str, *parts: str | Column) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"fact:{capability}/"), *[F.col(p[1:]) if isinstance(p, str) and p.startswith("$") else F.lit(p) if isinstance(p, str) else p for p in parts])


def suffix(kind: Column) -> Column:
    """How the id of a symbol ends: calls, types, all else."""
    return F.when(F.contains(kind, F.lit("function")), "().").when(kind.rlike("class|interface|type|enum|namespace"), "#").otherwise(".")


COLUMNS = ("name", "columns", "relations")
SHAPES = {
    "endpoint": Shape(_id("http-endpoints", "$method", " ", "$path"), ("method", "path")),
    "env-var": Shape(_id("config-surface", "$name"), ("name", "read_in_code", "declared_in_example"), 20),
    "package": Shape(_id("workspace-layout", "$name"), ("name", "path", "manager")),
    "service": Shape(_id("services-topology", "$name"), ("name", "kind", "image", "build", "ports", "depends_on")),
    "module": Shape(_id("module-graph", "$path"), ("path", "package", "imports")),
    "symbol": Shape(lambda: F.concat(F.lit("ds "), F.coalesce("package", F.lit(".")), F.lit(" . "), "module", F.lit("/"), "name", suffix(F.col("kind"))), ("name", "module", "package", "kind", "sigs")),
    "churn": Shape(_id("decision-history", "$path"), ("path", "commits", "last", "authors")),
    "policy": Shape(_id("db-policies", "policy.", "$schema", ".", "$table", ".", "$name"), ("schema", "table", "name", "command", "permissive", "roles", "using", "with_check")),
    "rls": Shape(_id("db-policies", "rls.", "$schema", ".", "$table"), ("schema", "table", "enabled")),
    "route": Shape(_id("client-routes", "$path"), ("path",)),
    "channel": Shape(_id("async-messaging", "$kind", ".", "$name"), ("name", "kind", "transport", "role", "pattern")),
    "table": Shape(_id("db-schema", "$name"), COLUMNS),
    "enum": Shape(_id("db-schema", "enum.", "$name"), ("name", "values")),
    "function": Shape(_id("db-schema", "fn.", "$name", "(", "$signature", ")"), ("name", "signature", "arguments", "returns", "kind", "set_returning", "volatility", "language", "security_definer", "body_digest")),
    "pk": Shape(_id("db-schema", "pk.", "$table"), ("table", "constraint", "columns")),
    "view": Shape(_id("db-schema", "view.", "$name"), ("name", "materialized", "columns", "insertable", "updatable", "deletable")),
}


def facts_of(rows: DataFrame, kind: str) -> DataFrame:
    """Facts of a type from rows that hold its attributes, and source, an array of places, if there are any. Attributes that rows lack are left out of the payload."""
    shape = SHAPES[kind]
    attrs = {a: F.col(f"`{a}`") for a in shape.attrs if a in rows.columns}
    source = None
    if "source" in rows.columns:
        source = F.col("source") if shape.sites is None else F.slice("source", 1, shape.sites)
    return normalise.facts(rows, kind, shape.id(), attrs, source)


def not_declared(live: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables of a live catalog(schema, table, ...) that no declared(name) covers: names are compared in lower case, in the public schema only."""
    names = declared.select(F.lower("name").alias("_l"), F.lit("public").alias("_s")).distinct()
    return live.join(names, (F.lower(live["table"]) == F.col("_l")) & (live["schema"] == F.col("_s")), "left_anti")


def nameless(name: Column, sigs: Column) -> Column:
    """Signatures without the symbol's name, by which a renamed one is found again."""
    return F.transform(sigs, lambda s: without_name(s, name))
