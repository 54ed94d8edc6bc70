"""Claims in documents that the repository doesn't bear out: files, links, scripts, make targets, versions, environment names, routes.

Input is lines(doc, line, text) of Markdown. A claim is suppressed where its line or section says that absence or creation is meant, or where its spelling
is a pattern rather than a name; suppressed claims are counted, not lost. Lines inside fenced code count, as commands stand there; drawings of trees don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import plain_parameters
from factweave.operators.extract import found

# Fixed words and shapes.
ABSENT = r"(?i)\b(retired|removed|deleted|dropped|sunset|decommissioned)\b"
PLACEHOLDER = r"(?i)(path/to|your[-_]|my[-_]|<[^>]+>|\{\{|\.\.\.|\bfoo\b|\bexample\.com\b|\*|x{3,})"
CONVENTIONAL = r"^(\.env(\..+)?|dist|build|node_modules|coverage|\.git|tmp|out)(/.*)?$"
IMPERATIVE = r"(?i)\b(create|touch|mkdir|add|save|write|generate|output|will (be )?(create|generate)|new file)\b"
TREE = r"[│├└┬─]|^\s*[|`]--"
FILE_NAME = r"^[\w.-]+\.(js|ts|mjs|json|md|ya?ml|sh|py|sql|prisma|env|toml)$"
VERSIONED = r"^@?[\w.-]+(/[\w.-]+)?@[\w.^~>=<-]+$"
COMMANDS = ("install", "ci", "i", "add", "remove", "init", "create", "publish", "audit", "link", "exec", "dlx", "upgrade", "why", "version", "login", "config", "run")
IMPLIED_RUN = ("test", "start", "stop", "restart", "dev", "build", "lint", "format", "typecheck", "watch", "e2e")
NOT_CLAIMED = ("NODE_ENV", "CI", "PATH", "HOME", "PWD", "TZ", "LANG", "DEBUG", "NODE_OPTIONS", "NPM_TOKEN", "GITHUB_TOKEN")
SCRIPT = r"\b((?:npm run|yarn run|pnpm run|yarn|pnpm|npm)\s+)([a-z][a-z0-9:_-]{1,40})\b"
CURL = r"curl[^\n]*?https?://([^/\s]+)(/[\w/:{}.\-]*)"
OWN_HOST = r"^(localhost|127\.0\.0\.1|0\.0\.0\.0)(:\d+)?$|\$\{|\$[a-z_]|<[a-z-]+>"
HEADING = r"^#{1,6}\s+(.*)$"


def with_section(lines: DataFrame) -> DataFrame:
    """Adds the text of the heading that a line stands under."""
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("text").rlike(HEADING), F.regexp_extract("text", HEADING, 1))
    return lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(upto), F.lit("")))


def _beside(doc: Column, target: Column) -> Column:
    """Places a path may name: from the root, and from the document's folder, with ./ and ../ resolved."""
    folder = F.regexp_extract(doc, "^(.*/)?", 0)
    clean = lambda p: F.aggregate(F.filter(F.split(p, "/"), lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_distinct(F.array(F.array_join(clean(target), "/"), F.array_join(clean(F.concat(folder, target)), "/")))


def _ticks(text: Column, pattern: str) -> Column:
    """Of each match whether it stands in code: after an odd number of backquotes."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g) - F.length(F.replace(g, F.lit("`"))))
    return F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda n: F.aggregate(F.slice(gaps, F.lit(1), n), F.lit(0), lambda s, x: s + x) % 2 == 1)


def claims(lines: DataFrame) -> DataFrame:
    """doc, line, class, claim, keys (any of which bears it out), needs (a folder without which it is a route of some app, not a file) and suppressed, of every claim."""
    text = F.col("text")
    rows = with_section(lines).where(~text.rlike(TREE)).withColumn("_absent", F.col("section").rlike(ABSENT)).withColumn("_told", text.rlike(IMPERATIVE))
    absent, told = F.col("_absent"), F.col("_told")
    none = F.lit(None).cast("string")
    item = lambda c, keys, hidden, needs=none: F.struct(c.alias("claim"), keys.alias("keys"), F.coalesce(hidden, F.lit(False)).alias("hidden"), needs.alias("needs"))
    ends = lambda c: F.regexp_replace(c, r"[.,;:!?)]+$", "")
    zipped = lambda pattern, *more: F.arrays_zip(*[found(text, pattern, g).alias(n) for n, g in more])

    token = F.filter(found(text, r"`([^`\s]{2,120})`"), lambda c: (F.contains(c, F.lit("/")) | c.rlike(FILE_NAME)) & ~c.rlike("^https?:|[=:]|^-"))
    first = lambda c: F.split_part(F.substring(c, 2, 1000), F.lit("/"), F.lit(1))
    route = lambda c: F.startswith(c, F.lit("/")) & ~c.rlike(r"(?i)\.[a-z0-9]{1,8}$")
    scripts = F.arrays_zip(found(text, SCRIPT, 1).alias("by"), found(text, SCRIPT, 2).alias("name"), F.slice(_ticks(text, SCRIPT), F.lit(1), F.size(found(text, SCRIPT))).alias("code"))
    version = F.regexp_extract("text", r"(?i)\bnode(?:\.js)?\s*(?:>=|v)?\s*(\d\d?)\b", 1)
    link = r"\]\((?!https?:|#|mailto:)([^)\s]+?)(?:#[^)]*)?\)"
    calls = zipped(r"\b(GET|POST|PUT|PATCH|DELETE)\s+(/[\w/:{}.\-]*)", ("verb", 1), ("path", 2))
    calls = F.transform(calls, lambda c: F.struct(c["verb"].alias("verb"), ends(c["path"]).alias("path")))
    curls = F.transform(zipped(CURL, ("host", 1), ("path", 2)), lambda c: F.struct(F.lower(c["host"]).alias("host"), ends(c["path"]).alias("path")))
    kinds = {
        "file": F.transform(token, lambda c: item(c, _beside(F.col("doc"), c), c.rlike(PLACEHOLDER) | c.rlike(CONVENTIONAL) | c.rlike(r"[{|]") | c.rlike(VERSIONED) | told | absent, F.when(route(c), first(c)))),
        "link": F.transform(found(text, link), lambda c: item(c, _beside(F.col("doc"), c), c.rlike(PLACEHOLDER) | c.rlike(r"[(|]") | c.rlike(r"^[\d.,\s-]+$"))),
        "script": F.transform(F.filter(scripts, lambda c: ~c["name"].isin(*COMMANDS)), lambda c: item(c["name"], F.array(c["name"]), ~(c["by"].rlike(r"\brun\s*$") | c["name"].isin(*IMPLIED_RUN) | c["code"]))),
        "make": F.transform(found(text, r"`make\s+([A-Za-z0-9][A-Za-z0-9_.-]{0,40})`"), lambda c: item(c, F.array(c), F.lit(False))),
        "version": F.when((version != "") & text.rlike(r"(?i)requir|need|install|version|newer|at least|\+|>="), F.array(item(F.concat(F.lit("node "), version), F.array(version), F.lit(False)))),
        "env": F.transform(F.filter(found(text, r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"), lambda c: ~c.isin(*NOT_CLAIMED)), lambda c: item(c, F.array(c), ~text.rlike("`|env|variable|export|="))),
        "route": F.transform(calls, lambda c: item(F.concat_ws(" ", c["verb"], c["path"]), F.array(F.concat_ws(" ", c["verb"], plain_parameters(c["path"])), F.concat_ws(" ", F.lit("PAGE"), plain_parameters(c["path"]))), absent)),
        "curl": F.transform(curls, lambda c: item(F.concat(F.lit("curl ..."), c["path"]), F.array(F.concat_ws(" ", F.lit("ANY"), plain_parameters(c["path"])), F.concat_ws(" ", F.lit("PAGE"), plain_parameters(c["path"]))), ~c["host"].rlike(OWN_HOST) | c["path"].isin("", "/") | absent)),
    }

    shape = "array<struct<class:string,claim:string,keys:array<string>,hidden:boolean,needs:string>>"
    of_class = lambda name, items: F.transform(items, lambda c: F.struct(F.lit(name).alias("class"), c["claim"].alias("claim"), c["keys"].alias("keys"), c["hidden"].alias("hidden"), c["needs"].alias("needs")))
    every = F.flatten(F.array(*[F.coalesce(of_class(k, v).cast(shape), F.array().cast(shape)) for k, v in kinds.items()]))
    out = rows.select("doc", "line", F.explode(every).alias("_c")).select("doc", "line", "_c.*")
    return out.withColumnRenamed("hidden", "suppressed")


def route_keys(facts: DataFrame) -> DataFrame:
    """Known keys of facts(capability, name): a route by its method and for curl by any, a page by its path."""
    method, path = F.split_part("name", F.lit(" "), F.lit(1)), plain_parameters(F.regexp_replace(F.regexp_replace("name", "^[A-Z]+ ", ""), "(.)/+$", "$1"))
    page = F.concat_ws(" ", F.lit("PAGE"), path)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("class"), key.alias("key"))
    keys = F.when(F.col("capability") == "client-routes", F.array(pair("route", page), pair("curl", page))).otherwise(F.array(pair("route", F.concat_ws(" ", method, path)), pair("curl", F.concat_ws(" ", F.lit("ANY"), path))))
    return facts.where(F.col("capability").isin("http-endpoints", "client-routes")).select(F.inline(keys)).distinct()


def unsupported(made: DataFrame, known: DataFrame, checked: list[str] | None = None) -> DataFrame:
    """Claims of which no key is in known(class, key): an anti-join on each key. Links may name what files name; routes are known by method and plain parameters.

    known holds folders at the root as class folder and installed packages as class file; checked names the classes that can be checked, all unless given.
    """
    rows = made.where("not suppressed").withColumn("_id", F.xxhash64("doc", "line", "class", "claim"))
    if checked is not None:
        rows = rows.where(F.col("class").isin(*checked))
    folders = known.where("class = 'folder'").select(F.col("key").alias("needs"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(folders, "needs", "left").where("needs is null or _there").drop("_there")
    keys = rows.select("_id", F.when(F.col("class") == "link", "file").otherwise(F.col("class")).alias("class"), F.explode("keys").alias("key"))
    borne = keys.join(known.select("class", "key").distinct(), ["class", "key"], "left_semi").select("_id").distinct()
    return rows.join(borne, "_id", "left_anti").select("doc", "line", "class", "claim")
