"""Names chased through imports: from modules and aliases to where a thing is made, and the routes of Python routers that hang on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import frameworks, graph
from factweave.operators.extract import found
from factweave.staging import written

HOPS = 6


def module_probes(file: Column, spec: Column) -> Column:
    """Paths that a Python module may have: each dot before it but the first is a folder up from the importing file's."""
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda p: p != "")
    up = F.slice(F.split(file, "/"), F.lit(1), F.greatest(F.size(F.split(file, "/")) - dots, F.lit(0)))
    stem = F.array_join(F.when(dots > 0, F.concat(up, rest)).otherwise(rest), "/")
    return F.array(F.concat(stem, F.lit(".py")), F.when(stem == "", "__init__.py").otherwise(F.concat(stem, F.lit("/__init__.py"))))


def chased(imports: DataFrame, made: DataFrame, asked: DataFrame, files: DataFrame, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """file, name, in_file and as_name of asked(file, name) that lead to made(file, name), and the gaps (file, name, reason).

    imports(file, line, local, module, name): the last line that binds a local name counts. `a.b` asks for b in the module that a is. Names lead from import to import, hops of them at most, by pointer
    doubling; a chain that ends in no file, at no maker, in a circle or beyond the hops is a gap.
    """
    node = lambda file, name: F.concat_ws("#", file, name)
    last = imports.groupBy("file", "local").agg(F.max_by(F.struct("module", "name"), "line").alias("_i")).select("file", "local", "_i.module", "_i.name")
    own = made.select("file", F.col("name").alias("local")).distinct()
    last = last.join(own, ["file", "local"], "left_anti")
    dotted = asked.where(F.contains("name", F.lit("."))).select("file", F.col("name").alias("asked"), F.substring_index("name", ".", 1).alias("local"), F.regexp_replace("name", r"^[^.]*\.", "").alias("attr"))
    dotted = dotted.join(last, ["file", "local"]).select("file", F.col("asked").alias("local"), F.concat("module", F.when(F.col("module").rlike(r"\.$"), "").otherwise("."), "name").alias("module"), F.col("attr").alias("name"))
    hop = written(last.unionByName(dotted.distinct()).withColumn("id", node(F.col("file"), F.col("local"))))
    there = graph.first_probe(hop.select("id", module_probes(F.col("file"), F.col("module")).alias("probes")), files)
    links = hop.join(there, "id").select(F.col("id").alias("node"), node(F.col("path"), F.col("name")).alias("parent"))
    makers = own.select(node(F.col("file"), F.col("local")).alias("node"))
    links = written(links.unionByName(makers.select("node", F.col("node").alias("parent"))))
    roots = graph.beginnings(links, hops)
    wanted = asked.select("file", "name").distinct().withColumn("node", node(F.col("file"), F.col("name")))
    out = written(wanted.join(roots, "node", "left"))
    good = out.where("root is not null").select("file", "name", F.substring_index("root", "#", 1).alias("in_file"), F.regexp_replace("root", "^[^#]*#", "").alias("as_name"))
    return good, out.where("root is null").select("file", "name", F.concat(F.lit("target `"), "name", F.lit("` not found")).alias("reason"))


IMPORT = r"^from\s+([.\w]+)\s+import\s+\(?([\w\s,]+?)\)?\s*$"
ROUTER = r"^(\w+)\s*=\s*(FastAPI|APIRouter)\((.*)$"
PREFIX = r"""\bprefix\s*=\s*["']([^"']*)["']"""
VERB = r"""^@(\w+)\.(get|post|put|patch|delete|options|head)\(\s*(?:["']([^"']*)["'])?"""
INCLUDE = r"^(\w+)\.include_router\(\s*([\w.]+)(.*)$"


def python_routes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """method, path and file of routes in lines(path, line, text) of Python files, under every prefix by which their routers are included, and gaps (file, reason).

    Statements are read one line at a time, from the line's first column.
    """
    rows = lines.where(F.col("path").rlike(r"\.py$") & ~F.col("path").rlike(r"(^|/)test_[^/]*$|_test\.py$")).select(F.col("path").alias("file"), "line", F.regexp_replace("text", r"\s+#.*$", "").alias("text"))
    rows = written(rows)
    get = lambda shape, n: F.regexp_extract("text", shape, n)
    node = lambda file, name: F.concat_ws("#", file, name)
    names = F.transform(F.split(get(IMPORT, 2), ","), lambda x: F.split(F.trim(x), r"\s+as\s+"))
    imports = rows.where(F.col("text").rlike(IMPORT)).select("file", "line", get(IMPORT, 1).alias("module"), F.explode(names).alias("_n")).where(F.col("_n")[0] != "")
    imports = imports.select("file", "line", F.element_at("_n", -1).alias("local"), "module", F.col("_n")[0].alias("name"))
    routers = rows.where(F.col("text").rlike(ROUTER)).select("file", get(ROUTER, 1).alias("name"), F.when(get(ROUTER, 2) == "FastAPI", "app").otherwise("router").alias("kind"), F.regexp_extract(get(ROUTER, 3), PREFIX, 1).alias("prefix"))
    routes = rows.where(F.col("text").rlike(VERB)).select(node(F.col("file"), get(VERB, 1)).alias("node"), F.upper(get(VERB, 2)).alias("method"), get(VERB, 3).alias("tail"), "file")
    mounts = rows.where(F.col("text").rlike(INCLUDE)).select("file", get(INCLUDE, 1).alias("into"), get(INCLUDE, 2).alias("name"), F.regexp_extract(get(INCLUDE, 3), PREFIX, 1).alias("part"))
    led, gaps = chased(imports, routers, mounts, rows.select(F.col("file").alias("path")).distinct())
    mounts = mounts.join(led, ["file", "name"]).select(node(F.col("file"), F.col("into")).alias("parent"), node(F.col("in_file"), F.col("as_name")).alias("child"), "part")
    made = routers.select(node(F.col("file"), F.col("name")).alias("node"), "kind", "prefix")
    return frameworks.router_paths(made, mounts, routes), gaps.select("file", F.concat(F.lit("include_router "), "reason").alias("reason"))
