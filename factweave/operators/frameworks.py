"""Facts whose rows follow from other rows: include graphs of routers, resource tables, folders, schema snapshots and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import graph

# --- routes -----------------------------------------------------------------------------------------------------------


def trimmed(path: Column) -> Column:
    """One slash before each part of a path and none at its end; the root is /."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/"))


def router_paths(routers: DataFrame, mounts: DataFrame, registrations: DataFrame) -> DataFrame:
    """method, path and file of registrations(node, method, tail, file) under every prefix by which routers(node, kind, prefix) are reached over mounts(parent, child, part).

    Apps and routers that nothing mounts are roots. A router's own prefix follows that of each mount.
    """
    own = routers.select(F.col("node").alias("child"), F.col("prefix").alias("_own"))
    mounted = mounts.select(F.col("child").alias("node")).distinct().withColumn("_in", F.lit(True))
    roots = routers.join(mounted, "node", "left").where("kind = 'app' or _in is null").select("node", F.concat(F.lit("/"), F.coalesce("prefix", F.lit(""))).alias("path"))
    edges = mounts.join(own, "child", "left").select("parent", "child", F.concat(F.lit("/"), F.coalesce("part", F.lit("")), F.lit("/"), F.coalesce("_own", F.lit(""))).alias("part"))
    reached = graph.prefixes(roots, edges).select("node", F.col("path").alias("_before"))
    rows = registrations.join(reached, "node", "left")
    return rows.select("method", trimmed(F.concat(F.coalesce("_before", F.lit("")), F.lit("/"), F.col("tail"))).alias("path"), "file").distinct()


def url_confs(routes: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """method ALL, path and file of routes(file, route) through includes(file, part, target); and gaps(file, reason) of targets that no file is.

    Files that none includes are roots; a file is not entered twice on a path.
    """
    known = routes.select("file").union(includes.select("file")).distinct()
    inside = includes.join(known.select(F.col("file").alias("target")), "target", "left_semi")
    gaps = includes.join(known.select(F.col("file").alias("target")), "target", "left_anti").select("file", F.concat(F.lit("outside the repository: "), F.coalesce(F.substring("target", 1, 40), F.lit("?"))).alias("reason")).distinct()
    roots = known.join(inside.select(F.col("target").alias("file")).distinct(), "file", "left_anti").select(F.col("file").alias("node"), F.lit("/").alias("path"))
    reached = graph.prefixes(roots, inside.select(F.col("file").alias("parent"), F.col("target").alias("child"), "part"))
    rows = routes.join(reached.select(F.col("node").alias("file"), F.col("path").alias("_before")), "file")
    return rows.select(F.lit("ALL").alias("method"), trimmed(F.concat("_before", "route")).alias("path"), "file").distinct(), gaps


# What one resource stands for, as (verb, tail, action).
PLURAL = (
    ("GET", "", "index"),
    ("GET", "/new", "new"),
    ("POST", "", "create"),
    ("GET", "/:id", "show"),
    ("GET", "/:id/edit", "edit"),
    ("PATCH", "/:id", "update"),
    ("PUT", "/:id", "update"),
    ("DELETE", "/:id", "destroy"),
)
SINGULAR = (
    ("GET", "/new", "new"),
    ("POST", "", "create"),
    ("GET", "", "show"),
    ("GET", "/edit", "edit"),
    ("PATCH", "", "update"),
    ("PUT", "", "update"),
    ("DELETE", "", "destroy"),
)


def resource_routes(resources: DataFrame) -> DataFrame:
    """file, method and path of resources(file, prefix, name, plural, only, except): a row for each verb whose action is allowed; only and except are arrays or null."""
    table = lambda rows: F.array(*[F.struct(F.lit(v).alias("method"), F.lit(t).alias("tail"), F.lit(a).alias("action")) for v, t, a in rows])
    rows = resources.withColumn("_v", F.explode(F.when(F.col("plural"), table(PLURAL)).otherwise(table(SINGULAR))))
    allowed = (F.col("only").isNull() | F.array_contains("only", F.col("_v.action"))) & (F.col("except").isNull() | ~F.array_contains("except", F.col("_v.action")))
    return rows.where(allowed).select("file", "_v.method", F.concat("prefix", F.lit("/"), "name", "_v.tail").alias("path")).distinct()


BLOCK = r"^(namespace|scope)\s+[:\"']([\w/-]+)[\"']?(.*)\bdo$"
RESOURCE = r"^(resources|resource)\s+:(\w+)(.*)$"
PLAIN = r"^(get|post|put|patch|delete)\s+[\"']([^\"']+)[\"']"
LIST = r"{}:\s*(?:%i)?\[([^\]]*)\]"


def resource_lines(lines: DataFrame) -> DataFrame:
    """file, method and path of routes written as nested blocks, from lines(file, line, text).

    Lines that open count up, `end` counts down, and the prefix is that of the last line that opened at each depth above the line's own.
    """
    text = F.trim(F.regexp_replace("text", "#.*$", ""))
    rows = lines.withColumn("text", text).where("text <> ''")
    opens = F.col("text").rlike(r"\bdo(\s*\|[^|]*\|)?$")
    tail = F.regexp_extract("text", RESOURCE, 2)
    part = F.when(F.col("text").rlike(BLOCK), F.concat(F.lit("/"), F.trim(F.regexp_extract("text", BLOCK, 2)))).when(F.col("text").rlike(r"^resources\s"), F.concat(F.lit("/"), tail, F.lit("/:id"))).when(F.col("text").rlike(r"^resource\s"), F.concat(F.lit("/"), tail)).otherwise("")
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(opens, 1).when(F.col("text") == "end", -1).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("part", part).withColumn("_step", step).withColumn("depth", F.coalesce(F.sum("_step").over(upto), F.lit(0)))
    # A line asks for the last block that opened at each depth above its own: a window for each file and depth, in which only openings have a part.
    mine = rows.where("depth > 0").select("file", "line", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("at"), F.lit(None).cast("string").alias("part"), F.lit(True).alias("asks"))
    begun = rows.where("opens").select("file", "line", F.col("depth").alias("at"), "part", F.lit(False).alias("asks"))
    before = Window.partitionBy("file", "at").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    open_ = mine.unionByName(begun).withColumn("_part", F.last("part", ignorenulls=True).over(before)).where("asks")
    prefix = open_.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_part"))), lambda x: x["_part"]), "").alias("prefix"))
    rows = rows.join(prefix, ["file", "line"], "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    listed = lambda word: F.when(F.col("text").rlike(LIST.format(word)), F.filter(F.split(F.regexp_extract("text", LIST.format(word), 1), r"[,\s:]+"), lambda x: x != ""))
    resources = rows.where(F.col("text").rlike(RESOURCE)).select("file", "prefix", tail.alias("name"), F.col("text").rlike(r"^resources\s").alias("plural"), listed("only").alias("only"), listed("except").alias("except"))
    target = F.regexp_extract("text", PLAIN, 2)
    plain = rows.where(F.col("text").rlike(PLAIN)).select("file", F.upper(F.regexp_extract("text", PLAIN, 1)).alias("method"), trimmed(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat("prefix", F.lit("/"), target))).alias("path"))
    root = rows.where(F.col("text").rlike(r"^root\b")).select("file", F.lit("GET").alias("method"), F.lit("/").alias("path"))
    return resource_routes(resources).unionByName(plain).unionByName(root).distinct()


def function_routes(files: DataFrame) -> DataFrame:
    """POST, path and file of each folder of functions with an entry file; folders whose names start with _ or . are shared code."""
    shape = r"^supabase/functions/([^_./][^/]*)/(index\.(?:ts|js|tsx))$"
    rows = files.where(F.col("path").rlike(shape)).select(F.regexp_extract("path", shape, 1).alias("name"), "path")
    order = F.array_position(F.array(*map(F.lit, ("index.ts", "index.js", "index.tsx"))), F.regexp_extract("path", shape, 2))
    return rows.groupBy("name").agg(F.min_by("path", order).alias("file")).select(F.lit("POST").alias("method"), F.concat(F.lit("/functions/v1/"), "name").alias("path"), "file")


# --- catalogs ---------------------------------------------------------------------------------------------------------


def schema_of(name: Column) -> Column:
    """The part of a qualified name before its first dot; empty if there is none."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1)).otherwise("")


def relation_of(name: Column) -> Column:
    """The part after the first dot."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def catalog_endpoints(relations: DataFrame, keyed: DataFrame, exposed: list[str]) -> tuple[DataFrame, DataFrame]:
    """method, path and derived_from of relations(id, kind, name, materialized, insertable, updatable, deletable, stable), and the ambiguous names.

    kind is table, view or function; name is qualified. Schemas share one space of paths: that which stands first in exposed wins, and its smallest id is the receipt. A
    table whose key is in keyed(name) takes PUT too; a view what it can; a function GET as well if one of its overloads is stable.
    """
    rank = F.array_position(F.array(*map(F.lit, exposed)), schema_of(F.col("name")))
    rows = relations.withColumn("rank", rank).where("rank > 0").withColumn("relation", relation_of(F.col("name")))
    keys = keyed.select("name", F.lit(True).alias("_key")).distinct()
    by_schema = rows.groupBy("kind", "relation", "rank", "name").agg(F.min(F.struct("id", "materialized", "insertable", "updatable", "deletable")).alias("_f"), F.bool_or(F.coalesce("stable", F.lit(False))).alias("_stable"))
    best = by_schema.groupBy("kind", "relation").agg(F.min_by(F.struct("name", "_f", "_stable"), "rank").alias("_w"), F.count("*").alias("_schemas")).select("kind", "relation", "_w.*", "_schemas").join(keys, "name", "left")
    flag = lambda c: F.coalesce(F.col(f"_f.{c}"), F.lit(False)) & ~F.coalesce(F.col("_f.materialized"), F.lit(False))
    offered = [
        ("GET", F.col("kind").isin("table", "view") | F.col("_stable")),
        ("POST", F.col("kind").isin("table", "function") | flag("insertable")),
        ("PATCH", (F.col("kind") == "table") | (F.col("kind") == "view") & flag("updatable")),
        ("DELETE", (F.col("kind") == "table") | (F.col("kind") == "view") & flag("deletable")),
        ("PUT", (F.col("kind") == "table") & F.coalesce("_key", F.lit(False))),
    ]
    verbs = F.array_compact(F.array(*[F.when(c, v) for v, c in offered]))
    path = F.concat(F.when(F.col("kind") == "function", "/rest/v1/rpc/").otherwise("/rest/v1/"), F.col("relation"))
    space = F.when(F.col("kind") == "function", "function").otherwise("relation")
    ambiguous = best.groupBy(space.alias("space"), "relation").agg(F.sum("_schemas").alias("n")).where("n > 1").select("relation").distinct()
    return best.select(F.explode(verbs).alias("method"), path.alias("path"), F.col("_f.id").alias("derived_from")), ambiguous


MODEL = r"^(model|enum)\s+(\w+)\s*\{"
FIELD = r"^(\w+)\s+([\w.]+)(\[\])?(\?)?\s*(.*)$"
SCALARS = ("String", "Int", "Float", "Boolean", "DateTime", "Json", "Bytes", "BigInt", "Decimal")
COMMENT = r"""^((?:[^"/]|"(?:[^"\\]|\\.)*"|/(?!/))*)//.*$"""


def model_fields(lines: DataFrame) -> DataFrame:
    """file, kind (model or enum), block, line, name, type, list, optional, relation and attrs of each line of lines(file, line, text) within a block.

    A line's block is that of the last opening line with no closing one between. Values of enums have a name only.
    """
    rows = lines.withColumn("text", F.trim(F.regexp_replace("text", COMMENT, "$1"))).where("text <> ''")
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("text").rlike(MODEL), F.struct(F.regexp_extract("text", MODEL, 1).alias("kind"), F.regexp_extract("text", MODEL, 2).alias("block"))).when(F.col("text") == "}", F.struct(F.lit("").alias("kind"), F.lit("").alias("block")))
    rows = rows.withColumn("_b", F.last(head, ignorenulls=True).over(upto)).where("_b.block <> ''").where(~F.col("text").rlike(MODEL) & ~F.startswith("text", F.lit("@@")))
    part = lambda n: F.regexp_extract("text", FIELD, n)
    model = F.col("_b.kind") == "model"
    rows = rows.where(~model | F.col("text").rlike(FIELD))
    upper = part(2).rlike("^[A-Z]") & ~part(2).isin(*SCALARS)
    only = lambda c: F.when(model, c)
    return rows.select("file", "_b.kind", "_b.block", "line", F.when(model, part(1)).otherwise(F.regexp_extract("text", r"^(\S+)", 1)).alias("name"), only(part(2)).alias("type"), only(part(3) != "").alias("list"), only(part(4) != "").alias("optional"), only(F.contains(part(5), F.lit("@relation(")) | upper).alias("relation"), only(part(5)).alias("attrs"))


SNAPSHOT = "enums map<string,struct<name:string,values:array<string>>>, tables map<string,struct<name:string,columns:map<string,struct<name:string,type:string,primaryKey:boolean,notNull:boolean,`default`:string>>,foreignKeys:map<string,struct<name:string,tableTo:string,columnsFrom:array<string>,columnsTo:array<string>>>>>"


def snapshot_columns(snapshots: DataFrame) -> DataFrame:
    """chain, model, name, type, optional, primary, enum and references of the latest snapshot, by idx, of each chain of snapshots(chain, idx, content as JSON)."""
    last = snapshots.groupBy("chain").agg(F.max_by("content", "idx").alias("content"))
    rows = last.select("chain", F.from_json("content", SNAPSHOT).alias("s"))
    enums = F.transform(F.map_values(F.coalesce("s.enums", F.create_map().cast("map<string,struct<name:string,values:array<string>>>"))), lambda e: e["name"])
    tables = rows.select("chain", enums.alias("_enums"), F.explode(F.map_values("s.tables")).alias("t"))
    columns = tables.select("chain", "_enums", F.col("t.name").alias("model"), F.explode(F.map_values("t.columns")).alias("c"))
    columns = columns.select("chain", "model", "c.name", "c.type", (~F.coalesce("c.notNull", F.lit(False))).alias("optional"), F.coalesce("c.primaryKey", F.lit(False)).alias("primary"), F.array_contains("_enums", F.col("c.type")).alias("enum"), F.lit(None).cast("array<string>").alias("references"))
    keys = tables.select("chain", F.col("t.name").alias("model"), F.explode(F.map_values("t.foreignKeys")).alias("k"))
    keys = keys.select("chain", "model", F.coalesce(F.when(F.col("k.tableTo") != "", F.lower("k.tableTo")), F.col("k.name")).alias("name"), F.col("k.tableTo").alias("type"), F.lit(True).alias("optional"), F.lit(False).alias("primary"), F.lit(False).alias("enum"), F.transform(F.arrays_zip(F.col("k.columnsFrom").alias("a"), F.col("k.columnsTo").alias("b")), lambda x: F.concat_ws("=", x["a"], x["b"])).alias("references"))
    return columns.unionByName(keys)


# --- symbols ----------------------------------------------------------------------------------------------------------


def signature_groups(declarations: DataFrame) -> DataFrame:
    """path, name, kind and sigs of declarations(path, name, kind, impl, sig): where a function has overloads, its implementation's signature is left out."""
    over = Window.partitionBy("path", "name")
    overloaded = F.bool_or((F.col("kind") == "function") & ~F.col("impl")).over(over) & F.bool_or("impl").over(over)
    rows = declarations.withColumn("_o", overloaded).where("not (_o and impl)")
    return rows.groupBy("path", "name").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kind"), F.array_sort(F.collect_set("sig")).alias("sigs"))


def flat_symbols(files: DataFrame) -> DataFrame:
    """path, package, name, kind and sigs of files(path, package, symbols): a symbol's own package goes before that of its file."""
    return files.select("path", "package", F.explode("symbols").alias("_s")).select("path", F.coalesce("_s.package", "package").alias("package"), "_s.name", "_s.kind", "_s.sigs")
