"""Packages of a repository: members that its manifest names by globs, what they call themselves, and what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.globs import selected

# Fixed names, in the order in which a folder is asked for its name.
IDENTITIES = ("package.json", "pyproject.toml", "pubspec.yaml", "go.mod", "pom.xml")
YAML_ITEM = r"(?m)^\s+-\s*[\"']?([^\"'#\s]+)[\"']?"


def _folder(path: Column) -> Column:
    folder = F.regexp_replace(path, r"/?[^/]+$", "")
    return F.when(folder == "", ".").otherwise(folder)


def _name(file: Column, text: Column) -> Column:
    """What one manifest calls its package; null if it doesn't say."""
    project = F.regexp_extract(text, r"(?s)(?:^|\n)\[project\](.*?)(?=\n\[|$)", 1)
    own = F.regexp_replace(text, r"(?s)<(parent|dependencies|build|profiles)\b.*?</\1>", "")
    found = (
        F.when(file == "package.json", F.get_json_object(text, "$.name"))
        .when(file == "pyproject.toml", F.regexp_extract(project, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1))
        .when(file == "pubspec.yaml", F.regexp_extract(text, r"(?m)^name:\s*[\"']?([^\"'#\s]+)", 1))
        .when(file == "go.mod", F.regexp_extract(text, r"(?m)^module\s+(?:\S*/)?([^/\s]+)/?\s*$", 1))
        .when(file == "pom.xml", F.regexp_extract(own, r"<artifactId>\s*([^<\s]+)\s*</artifactId>", 1))
    )
    return F.when(found != "", found)


def identities(files: DataFrame, *keys: str) -> DataFrame:
    """keys, folder and name of each folder of files(keys, path, content) with a manifest: what the first of IDENTITIES that names it says; null if none does."""
    file = F.element_at(F.split("path", "/"), -1)
    order = F.array_position(F.array(*map(F.lit, IDENTITIES)), file)
    rows = files.where(file.isin(*IDENTITIES)).select(*keys, _folder(F.col("path")).alias("folder"), order.alias("o"), _name(file, F.col("content").cast("string")).alias("name"))
    return rows.groupBy(*keys, "folder").agg(F.min(F.when(F.col("name").isNotNull(), F.struct("o", "name")))["name"].alias("name"))


def declared(files: DataFrame) -> DataFrame:
    """root, manager, file, glob, and problem, of the manifests of workspaces in files(root, path, content): pnpm's list goes before package.json's. glob is null with a problem."""
    text = F.col("content").cast("string")
    pnpm = files.where("path = 'pnpm-workspace.yaml'").select("root", "path", F.lit("pnpm").alias("manager"), text.rlike("\t").alias("broken"), F.regexp_extract(text, r"(?ms)^packages:\s*\n((?:[ \t]+.*\n?|\n)+)", 1).alias("list"))
    pnpm = pnpm.select("root", "manager", "path", "broken", F.lit(True).alias("says"), F.regexp_extract_all("list", F.lit(YAML_ITEM), F.lit(1)).alias("globs"))
    either = F.coalesce(F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>"), F.from_json(F.get_json_object(text, "$.workspaces.packages"), "array<string>"))
    npm = files.where("path = 'package.json'").select("root", F.lit("npm-yarn").alias("manager"), "path", F.try_parse_json(text).isNull().alias("broken"), F.get_json_object(text, "$.workspaces").isNotNull().alias("says"), F.coalesce(either, F.array().cast("array<string>")).alias("globs"))
    npm = npm.join(pnpm.select("root"), "root", "left_anti")
    rows = pnpm.unionByName(npm)
    problem = F.when(F.col("broken"), "workspace-manifest-unparsed").when(F.col("says") & (F.size("globs") == 0), "workspace-no-packages-declared")
    return rows.select("root", "manager", F.col("path").alias("file"), F.explode_outer("globs").alias("glob"), problem.alias("problem"))


def layout(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """root, manager, file, name and path of the packages of each repository in files(root, path, content), and root, kind and file of what is wrong.

    A member is a folder that a glob names and that has a package.json; without one it is a gap. A repository with no members is one package, called by the first manifest at its root that
    names it or else by the root's own name. Null contents are empty ones.
    """
    files = files.select("root", "path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    found = declared(files)
    # Globs stay within their repository: its name is the first segment of both sides, with no slash of its own.
    key = F.hex(F.encode("root", "UTF-8"))
    folders = files.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n - 1), "/"))).alias("folder")).where("folder <> ''").distinct()
    globs = found.where("glob is not null and problem is null").select(key.alias("set"), "glob")
    away = F.startswith("glob", F.lit("!"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", "^!", ""), r"^\./", ""), "/+$", "")
    globs = globs.select("set", F.concat(F.when(away, "!").otherwise(""), "set", F.lit("/"), bare).alias("glob"))
    hit = selected(folders.select(F.concat(key, F.lit("/"), "folder").alias("path")), globs)
    hit = hit.select(F.decode(F.unhex("set"), "UTF-8").alias("root"), F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    names = files.select("root").distinct()
    ids = identities(files, "root").withColumnRenamed("folder", "path")
    has = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("root", _folder(F.col("path")).alias("path"))
    members = hit.join(has, ["root", "path"], "left_semi").join(ids, ["root", "path"], "left")
    by = found.groupBy("root").agg(F.first("manager").alias("manager"), F.first("file").alias("file"))
    members = members.join(by, "root").select("root", "manager", "file", F.coalesce("name", F.element_at(F.split("path", "/"), -1)).alias("name"), "path")
    single = names.join(members.select("root"), "root", "left_anti").join(ids.where("path = '.'").drop("path"), "root", "left")
    first = files.where(F.col("path").isin(*IDENTITIES)).groupBy("root").agg(F.min_by("path", F.array_position(F.array(*map(F.lit, IDENTITIES)), F.col("path"))).alias("file"))
    single = single.join(first, "root", "left").select("root", F.lit("single").alias("manager"), "file", F.coalesce("name", F.element_at(F.split("root", "/"), -1)).alias("name"), F.lit(".").alias("path"))
    lost = hit.join(has, ["root", "path"], "left_anti").select("root", F.lit("workspace-member-unresolved").alias("kind"), F.col("path").alias("file"))
    wrong = found.where("problem is not null").select("root", F.col("problem").alias("kind"), "file").distinct()
    return members.unionByName(single), lost.unionByName(wrong)
