"""Facts read from source lines by patterns: environment names, messaging channels, page routes, HTTP endpoints.

Input is lines(path, line, text). Patterns see one line at a time, and names are told apart by file; what needs a full parser of a language is not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import derive, graph

NAME = "[A-Z][A-Z0-9_]*"
# Fixed spellings by which languages read a variable of the environment.
ENV_READS = (
    rf"process\.env\.({NAME})",
    rf"import\.meta\.env\.({NAME})",
    rf"""os\.environ(?:\.get)?\s*[\[(]\s*["']({NAME})["']""",
    rf"""os\.getenv\(\s*["']({NAME})["']""",
    rf"""os\.(?:Getenv|LookupEnv)\(\s*"({NAME})\"""",
    rf"""System\.getenv\(\s*"({NAME})\"""",
    rf"""\benv\(\s*["']({NAME})["']\s*\)""",
    rf"""String\.fromEnvironment\(\s*["']({NAME})["']""",
    rf"""Platform\.environment\[\s*["']({NAME})["']""",
)
EXAMPLE = r"(^|/)\.?env[^/]*\.(example|sample|template)$|(^|/)\.env\.(example|sample|template)$"


def lines(files: DataFrame) -> DataFrame:
    """path, line and text of each line of files(path, content)."""
    text = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n"), "\n")
    return files.select("path", F.posexplode(text).alias("_n", "text")).select("path", (F.col("_n") + 1).alias("line"), "text")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def literal_of(pattern: str) -> str | None:
    """The characters with which every match of a pattern begins, if its beginning is plain: a cheap test before the pattern."""
    out, i = "", 0
    while i < len(pattern):
        c, after = pattern[i], pattern[i + 1 : i + 2]
        if c == "\\" and after and not after.isalnum():
            c, i = after, i + 1
        elif not (c.isalnum() or c in "_-/ "):
            break
        if pattern[i + 1 : i + 2] in ("?", "*", "{"):
            break
        out, i = out + c, i + 1
    return out if len(out) > 2 else None


def screened(text: Column, pattern: str, group: int = 1) -> Column:
    """found(), but the pattern only runs on texts that hold its literal."""
    literal = literal_of(pattern)
    if literal is None:
        return found(text, pattern, group)
    return F.when(F.contains(text, F.lit(literal)), found(text, pattern, group)).otherwise(F.array().cast("array<string>"))


def worth_reading(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds the literal of any pattern, all in one filter of the scan; true for all texts if a pattern has none."""
    literals = [literal_of(p) for p in patterns]
    held = F.lit(None in literals)
    for x in sorted({x for x in literals if x}):
        held = held | F.contains(text, F.lit(x))
    return held


def env_names(rows: DataFrame, sites: int = 20) -> DataFrame:
    """name, whether it is read in code and declared in an example file, and its first sites."""
    example = F.col("path").rlike(EXAMPLE)
    read = F.when(~example, F.concat(*[screened(F.col("text"), p) for p in ENV_READS])).otherwise(found(F.col("text"), rf"^\s*({NAME})\s*="))
    names = rows.select("path", "line", F.explode(read).alias("name"), example.alias("declared")).withColumn("read_in_code", ~F.col("declared"))
    return derive.name_status(names, ["name"], ["read_in_code", "declared"], F.struct("path", "line"), sites)


class ChannelRule(NamedTuple):
    """A call that names a channel in its first group."""

    kind: str
    transport: str
    role: str
    pattern: str


# Fixed spellings of common clients.
CHANNEL_RULES = (
    ChannelRule("topic", "kafka", "producer", r"""\.send\(\s*\{\s*topic:\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("topic", "kafka", "consumer", r"""\.subscribe\(\s*\{\s*topics?:\s*\[?\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("queue", "rabbitmq", "producer", r"""\.sendToQueue\(\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("queue", "rabbitmq", "consumer", r"""\.consume\(\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("channel", "redis", "producer", r"""\.publish\(\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("channel", "redis", "consumer", r"""\.subscribe\(\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("queue", "sqs-sns", "producer", r"""\b(?:SendMessage(?:Batch)?Command|send_message)\([^)]*?QueueUrl\s*[:=]\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("queue", "sqs-sns", "consumer", r"""\b(?:(?:Receive|Delete)MessageCommand|receive_message)\([^)]*?QueueUrl\s*[:=]\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("topic", "sqs-sns", "producer", r"""(?:\bPublishCommand|\bsns\w*\.publish)\([^)]*?TopicArn\s*[:=]\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("topic", "sqs-sns", "consumer", r"""\bSubscribeCommand\([^)]*?TopicArn\s*[:=]\s*["'`]([^"'`]+)["'`]"""),
    ChannelRule("channel", "supabase-realtime", "both", r"""\b\w*(?:supabase|client|db)\w*\.(?:channel|removeChannel)\(\s*["'`]([^"'`]+)["'`]"""),
)


def channels(rows: DataFrame, rules: tuple[ChannelRule, ...] = CHANNEL_RULES) -> DataFrame:
    """kind, name, transport, role (both where sides differ) and number of files; parts filled in at run time stand as {}."""

    def named(r: ChannelRule) -> Column:
        return F.transform(screened(F.col("text"), r.pattern), lambda n: F.struct(F.lit(r.kind).alias("kind"), n.alias("name"), F.lit(r.transport).alias("transport"), F.lit(r.role).alias("role")))

    calls = F.flatten(F.array(*map(named, rules)))
    rows = rows.where(worth_reading(F.col("text"), [r.pattern for r in rules]))
    hits = rows.select(F.col("path").alias("file"), F.explode(calls).alias("_c")).select("file", "_c.*").withColumn("name", F.regexp_replace("name", r"\$\{[^}]*\}", "{}"))
    return derive.merged_channels(hits, ["kind", "name", "transport"])


def page_routes(files: DataFrame, root: str = "app") -> DataFrame:
    """Routes of pages by place: root/(group)/[id]/page.tsx is /:id, the first path of each route by order of paths."""
    inside = files.where(F.col("path").rlike(rf"^(?:src/)?{root}/(?:.*/)?page\.(?:tsx|jsx|ts|js)$"))
    route = F.regexp_replace(F.regexp_replace("path", rf"^(?:src/)?{root}", ""), r"/page\.\w+$", "")
    route = F.regexp_replace(F.regexp_replace(route, r"/\([^)]*\)", ""), r"\[(?:\.\.\.)?([^\]]+)\]", ":$1")
    return inside.select(F.when(route == "", "/").otherwise(route).alias("route"), "path").groupBy("route").agg(F.min("path").alias("path"))


VERB = r"""\b(\w+)\.(get|post|put|patch|delete)\(\s*["'`](/[^"'`]*|)["'`]"""
MOUNT = r"""\b(\w+)\.use\(\s*["'`](/[^"'`]*)["'`]\s*,\s*(\w+)"""
MADE = r"""\b(?:const|let|var)\s+(\w+)\s*=\s*(?:\w+\.)?(?:Router|express)\("""
TAKEN = r"""\b(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*["']\./([^"']+)["']|\bimport\s+(\w+)\s+from\s+["']\./([^"']+)["']"""
GIVEN = r"""module\.exports\s*=\s*(\w+)|export\s+default\s+(\w+)"""


def endpoints(rows: DataFrame) -> DataFrame:
    """method, path and file of each registration, under every chain of mounts by which its router is reached; one that nothing mounts stands alone."""
    node = lambda file, name: F.concat_ws("#", file, name)
    part = lambda pattern, *groups: F.arrays_zip(*[found(F.col("text"), pattern, g).alias(n) for n, g in groups])
    calls = rows.select("path", F.explode(part(VERB, ("name", 1), ("verb", 2), ("tail", 3))).alias("_v")).select(node(F.col("path"), F.col("_v.name")).alias("node"), F.upper("_v.verb").alias("method"), F.col("_v.tail").alias("tail"), "path")
    mounts = rows.select("path", F.explode(part(MOUNT, ("name", 1), ("part", 2), ("child", 3))).alias("_m")).select("path", "_m.*")
    taken = rows.select("path", F.explode(part(TAKEN, ("a", 1), ("b", 2), ("c", 3), ("d", 4))).alias("_t"))
    folder = F.regexp_extract("path", "^(.*/)?", 0)
    taken = taken.select("path", F.concat("_t.a", "_t.c").alias("child"), F.regexp_replace(F.concat(folder, F.concat("_t.b", "_t.d")), r"\.\w+$", "").alias("stem"))
    given = rows.select(F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), r"/index$", "").alias("stem"), F.col("path").alias("other"), F.explode(part(GIVEN, ("a", 1), ("b", 2))).alias("_g")).select("stem", "other", F.concat("_g.a", "_g.b").alias("made"))
    imported = taken.join(given, "stem").select("path", "child", node(F.col("other"), F.col("made")).alias("_far"))
    mounts = mounts.join(imported, ["path", "child"], "left").select(node(F.col("path"), F.col("name")).alias("parent"), F.coalesce("_far", node(F.col("path"), F.col("child"))).alias("child"), "part")
    nodes = calls.select("node").union(mounts.select("parent")).distinct()
    roots = nodes.join(mounts.select(F.col("child").alias("node")).distinct(), "node", "left_anti").select("node", F.lit("").alias("path"))
    reached = graph.prefixes(roots, mounts).select("node", F.col("path").alias("prefix"))
    full = F.regexp_replace(F.concat("prefix", "tail"), "(.)/$", "$1")
    return calls.join(reached, "node").select("method", F.when(full == "", "/").otherwise(full).alias("route"), F.col("path").alias("file")).distinct()


def packages(files: DataFrame) -> DataFrame:
    """name and path of each package manifest; one without a name is called by its folder."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    name = F.get_json_object(F.decode("content", "UTF-8"), "$.name")
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$"))
    return rows.select(F.coalesce(name, F.when(folder == "", ".").otherwise(folder)).alias("name"), F.when(folder == "", ".").otherwise(folder).alias("path"))


def churn(log: DataFrame, end: str, days: int = 365) -> DataFrame:
    """path, commits, last and authors of log(sha, author, at, path) in the days up to end; times are ISO dates, compared as dates."""
    recent = log.where(F.to_date("at") > F.date_sub(F.lit(end).cast("date"), days))
    return recent.groupBy("path").agg(F.count_distinct("sha").alias("commits"), F.max("at").alias("last"), F.count_distinct("author").alias("authors"))
