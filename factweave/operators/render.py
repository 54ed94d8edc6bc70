"""Bodies of generated regions, from rows of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def table(rows: DataFrame, region: str, order: str, columns: list[str]) -> DataFrame:
    """region and body: a Markdown table of the region's rows in order. A region's rows are gathered; it is a section for people to read."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(F.col(c).cast("string")), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    held = rows.groupBy(region).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_l"))
    return held.select(region, F.concat(F.lit(head), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("body"))


def diagram(relations: DataFrame, chunk: str = "chunk") -> DataFrame:
    """chunk and body: an entity diagram of relations(chunk, from, to, field)."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), name("from"), F.lit(" }o--|| "), name("to"), F.lit(' : "'), F.replace(F.col("field"), F.lit('"'), F.lit("'")), F.lit('"'))
    return relations.groupBy(chunk).agg(F.concat(F.lit("erDiagram\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("body"))


def _listed(rows: DataFrame, head: str, line: Column, *order: str) -> DataFrame:
    """body: a table of one line for each row, in order. It is a section for people to read, so its rows are gathered."""
    held = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return held.select(F.array_join(F.concat(F.array(F.lit(head)) if head else F.array().cast("array<string>"), F.transform("_l", lambda x: x["_line"])), "\n").alias("body"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in cells]), F.lit(" |"))


def _head(*names: str) -> str:
    return f"| {' | '.join(names)} |\n|{'---|' * len(names)}"


def _code(c: str) -> Column:
    return F.concat(F.lit("`"), cell(F.col(c).cast("string")), F.lit("`"))


def body(kind: str, rows: DataFrame) -> DataFrame:
    """body of the section of one type of facts, from rows of their attributes."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    some = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ", "))
    verbs = F.array_join(F.array_compact(F.array(F.lit("GET"), *[F.when(F.col(c), v) for v, c in (("POST", "insertable"), ("PATCH", "updatable"), ("DELETE", "deletable"))])), ", ") if kind == "view" else None
    if kind == "env-var":
        return _listed(rows, _head("variable", "read in code", "in .env.example", "read sites"), _row(_code("name"), yes("read_in_code"), yes("declared_in_example"), F.when(F.size("sites") > 0, cell(F.array_join(F.slice("sites", 1, 3), ", ")))), "name")
    if kind == "enum":
        return _listed(rows, "", F.concat(F.lit("- "), _code("name"), F.lit(": "), F.array_join("values", ", ")), "name")
    if kind == "view":
        return _listed(rows, _head("relation", "kind", "columns", "REST verbs"), _row(_code("name"), F.when(F.col("materialized"), "materialized").otherwise("view"), F.array_join(F.transform("columns", lambda c: F.concat(F.lit("`"), cell(c), F.lit("`"))), ", "), verbs), "name")
    if kind == "function":
        traits = F.concat_ws(", ", "volatility", "language", F.when(F.col("security_definer"), "security definer"), F.when(F.col("kind") == "procedure", "procedure"))
        return _listed(rows, _head("routine", "arguments", "returns", "properties"), _row(_code("name"), F.when(F.col("arguments") != "", _code("arguments")), _code("returns"), cell(traits)), "name", "signature")
    if kind == "policy":
        return _listed(rows, _head("table", "policy", "command", "mode"), _row(F.concat(F.lit("`"), cell(F.concat_ws(".", "schema", "table")), F.lit("`")), _code("name"), cell(F.col("command")), F.when(F.col("permissive"), "permissive").otherwise("restrictive")), "schema", "table", "name")
    if kind == "rls":
        return _listed(rows, "", F.concat(F.lit("- RLS "), F.when(F.col("enabled"), "enabled").otherwise("**disabled**"), F.lit(" on `"), F.concat_ws(".", "schema", "table"), F.lit("`")), "schema", "table")
    if kind == "service":
        return _listed(rows, _head("service", "kind", "image", "build", "ports", "depends on"), _row(_code("name"), cell(F.col("kind")), F.when(F.col("image") != "", _code("image")), F.when(F.col("build") != "", _code("build")), some("ports"), some("depends_on")), "name")
    if kind == "package":
        return _listed(rows, _head("package", "path", "manager"), _row(_code("name"), _code("path"), cell(F.col("manager"))), "path")
    if kind == "endpoint":
        return _listed(rows, _head("method", "path"), _row(cell(F.col("method")), _code("path")), "path", "method")
    if kind == "route":
        return _listed(rows, "", F.concat(F.lit("- "), _code("path")), "path")
    if kind == "channel":
        return _listed(rows, _head("channel", "kind", "transport", "role"), _row(_code("name"), cell(F.col("kind")), cell(F.col("transport")), cell(F.col("role"))), "name", "kind")
    raise ValueError(f"no section for {kind}")


def services_diagram(services: DataFrame) -> DataFrame:
    """body: a flow chart of services(name, kind, depends_on); owned ones are boxes, others stores."""
    mark = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    box = F.when(F.col("kind") == "owned", F.concat(F.lit('["'), "name", F.lit('"]'))).otherwise(F.concat(F.lit('[("'), "name", F.lit('")]')))
    nodes = services.select(F.lit(0).alias("part"), F.col("name").alias("o"), F.concat(F.lit("  "), mark("name"), box).alias("line"))
    edge = F.concat(F.lit("  "), mark("name"), F.lit(" --> "), mark("_d"))
    edges = services.select("name", F.explode("depends_on").alias("_d")).select(F.lit(1).alias("part"), edge.alias("o"), edge.alias("line"))
    held = nodes.unionByName(edges).agg(F.array_sort(F.collect_list(F.struct("part", "o", "line"))).alias("_l"))
    return held.select(F.concat(F.lit("```mermaid\nflowchart LR\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n```")).alias("body"))
