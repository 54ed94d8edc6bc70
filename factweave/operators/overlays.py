"""Values of charts: nested documents as rows of paths, laid over each other, and templates filled in from them.

A document becomes one row for each leaf. Of two layers the higher one wins wherever they meet: a leaf replaces the leaf, the tree below it, or the leaf above it; trees are merged. Both ways of meeting are
joins by equality on leading parts of paths. References are filled by joins, pass after pass, until none is left that is known; the others are gaps, never guesses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.derive import merged_services
from factweave.staging import written

SPLIT = "."


def leaves(documents: DataFrame) -> DataFrame:
    """chart, layer, path (keys joined by dots) and value of each leaf of documents(chart, layer, content as JSON), level by level, as deep as they are.

    Lists are leaves, as JSON; so are empty trees. Null leaves are kept. A text that is itself a JSON object counts as a tree.
    """
    tree = lambda c: F.from_json(c, "map<string,string>")  # noqa: E731  plain values come bare, nested ones as JSON
    rows, done = written(documents.select("chart", "layer", F.explode(tree("content")).alias("path", "value"))), []
    while not rows.isEmpty():
        deep = F.startswith("value", F.lit("{")) & (F.coalesce(F.size(tree("value")), F.lit(0)) > 0)
        done.append(rows.where(~F.coalesce(deep, F.lit(False))))
        inner = rows.where(deep).select("chart", "layer", "path", F.explode(tree("value")).alias("k", "value"))
        rows = written(inner.select("chart", "layer", F.concat_ws(SPLIT, "path", "k").alias("path"), "value"))
    return reduce(DataFrame.unionByName, done, rows)


def _above(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SPLIT))


def overlaid(rows: DataFrame) -> DataFrame:
    """chart, path and value of what is left of rows(chart, layer, path, value) once higher layers have replaced what they meet; a null value takes away and is not left."""
    parts = written(rows.select("chart", "layer", "path", F.explode(_above(F.col("path"))).alias("up")))
    # A higher leaf at one of my leading parts, my own path among them; a higher leaf somewhere below me.
    leaf = rows.groupBy("chart", F.col("path").alias("up")).agg(F.max("layer").alias("_leaf"))
    over = parts.join(leaf, ["chart", "up"]).groupBy("chart", "layer", "path").agg(F.max("_leaf").alias("_over"))
    under = parts.groupBy("chart", F.col("up").alias("path")).agg(F.max("layer").alias("_under"))
    left = rows.join(over, ["chart", "layer", "path"]).join(under, ["chart", "path"])
    return left.where("_over <= layer and _under <= layer and value is not null").select("chart", "path", "value")


HOLE = r"\{\{-?\s*([^}]*?)\s*-?\}\}"
VALUE = r"^\.Values\.([A-Za-z0-9_.]+)$"
CHART = r"^\.Chart\.(Name|Version)$"
CONTROL = ("if", "end", "else", "range", "with", "define", "include", "template", "tpl", "toYaml", "printf")


def _once(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts(id, chart, text) with every reference filled that is known(chart, name, value); texts are cut into pieces as rows and put together again."""
    holes, between = F.regexp_extract_all("text", F.lit(HOLE), F.lit(1)), F.split("text", HOLE, -1)
    raw = F.concat(F.regexp_extract_all("text", F.lit(HOLE), F.lit(0)), F.array(F.lit("")))
    pieces = F.arrays_zip(between.alias("gap"), F.concat(holes, F.array(F.lit(None).cast("string"))).alias("name"), raw.alias("raw"))
    rows = texts.select("id", "chart", F.posexplode(pieces).alias("at", "p")).select("id", "chart", "at", "p.gap", "p.name", "p.raw")
    rows = rows.join(known, ["chart", "name"], "left").withColumn("t", F.concat("gap", F.coalesce("value", "raw")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "")
    return rows.groupBy("id", "chart").agg(joined.alias("text"), F.bool_or(F.col("value").isNotNull()).alias("_filled"))


def filled(texts: DataFrame, values: DataFrame, charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts(id, chart, text) with references to values(chart, path, value) and charts(chart, name, version) filled, and the gaps (id, reason).

    Values may hold references themselves; they are filled first, in as many passes as references are deep; those in a circle stay unknown. Flow of control is left out and told, since what comes out
    depends on an installation; any other expression stands as <unknown:...>.
    """
    about = charts.select("chart", F.explode(F.create_map(F.lit(".Chart.Name"), "name", F.lit(".Chart.Version"), "version")).alias("name", "value")).where("value is not null")
    hole = F.col("value").rlike(HOLE)
    own = written(values.select("chart", F.concat(F.lit(".Values."), "path").alias("name"), "value").unionByName(about))
    while True:
        plain, deep = own.where(~hole), own.where(hole)
        if deep.isEmpty():
            break
        new = _once(deep.select(F.col("name").alias("id"), "chart", F.col("value").alias("text")), plain)
        if new.where("_filled").isEmpty():
            break
        own = written(plain.unionByName(new.select("chart", F.col("id").alias("name"), F.col("text").alias("value"))))
    out = written(_once(texts, own.where(~hole)).select("id", "chart", "text"))
    left = out.select("id", F.explode(F.regexp_extract_all("text", F.lit(HOLE), F.lit(1))).alias("e")).distinct()
    control = F.split_part("e", F.lit(" "), F.lit(1)).isin(*CONTROL)
    reason = F.when(control, "template control flow - the rendered set is install-dependent").when(F.col("e").rlike(VALUE), F.concat(F.lit("undeclared value "), "e")).otherwise(F.concat(F.lit("unresolved template expression: "), F.substring("e", 1, 40)))
    gaps = left.select("id", reason.alias("reason")).distinct()
    text = F.regexp_replace("text", r"\{\{-?\s*(?:" + "|".join(CONTROL) + r")\b[^}]*\}\}", "")
    shown = F.regexp_replace(F.regexp_replace(text, HOLE, "<unknown:$1>"), r"(<unknown:[^>]{40})[^>]*>", "$1>")
    return out.select("id", "chart", shown.alias("text")), gaps


WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "ReplicaSet")


def services(texts: DataFrame) -> DataFrame:
    """chart, name, kind (owned or external), image and ports of the workloads and services in filled texts(id, chart, text), one row for each name; owned beats external and keeps both's ports.

    Documents are told apart by lines of three dashes; kind, the name under metadata, the first image and the ports are read by their lines.
    """
    docs = texts.select("id", "chart", F.explode(F.split("text", r"(?m)^---.*$", -1)).alias("d"))
    get = lambda shape: F.regexp_extract("d", shape, 1)
    name = get(r"(?m)^metadata:[^\n]*\n(?:[ \t]+(?!name:)[^\n]*\n)*[ \t]+name:[ \t]*[\"']?([^\"'\s#]+)")
    rows = docs.withColumn("k", get(r"(?m)^kind:\s*(\w+)")).where(F.col("k").isin(*WORKLOADS, "Service"))
    image = get(r"(?m)^[\s-]*image:[ \t]*[\"']?([^\"'\s#]+)")
    ports = F.when(F.col("k") == "Service", F.regexp_extract_all("d", F.lit(r"(?m)^[\s-]*port:[ \t]*[\"']?([^\"'\s#]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    stem = F.regexp_replace(F.element_at(F.split("id", "/"), -1), r"\.[^.]*$", "")
    rows = rows.select("chart", F.when(name == "", stem).otherwise(name).alias("name"), (F.col("k") != "Service").alias("owned"), F.when(image != "", image).alias("image"), ports.alias("ports"))
    rows = written(rows)
    images = rows.where("owned").groupBy("chart", "name").agg(F.min("image").alias("image"))
    merged = merged_services(rows, ["chart", "name"]).join(images, ["chart", "name"], "left")
    return merged.select("chart", "name", F.when(F.col("owned"), "owned").otherwise("external").alias("kind"), "image", "ports")
