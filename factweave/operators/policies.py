"""Row policies of a chain of SQL files: statements told apart by a lexer, then replayed in order, names followed through renames of policies and tables.

The lexer is one pattern whose alternatives are comments, quoted text, dollar-quoted text, brackets, semicolons and the rest; which statement a token belongs to and how deep in brackets
it is are running sums over rows. A statement is its head, the text outside brackets with (1), (2), ... for what they hold, and that as a list; so words within brackets or quotes
are never taken for clauses. Comments do not nest, and a backslash does not escape a quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.replay import lives
from factweave.staging import written

# Fixed places of migration files.
MIGRATIONS = r"(^|/)(supabase/migrations|migrations|db/migrations|sql)/"
TOKEN = r"""(?s)--[^\n]*|/\*.*?\*/|'[^']*'?|"[^"]*"?|\$(\w*)\$.*?\$\1\$|[();]|[^-/'"$();]+|."""


def in_migrations(path: Column) -> Column:
    return path.rlike(MIGRATIONS) & F.endswith(path, F.lit(".sql"))


def statements(files: DataFrame) -> DataFrame:
    """path, number (from 0), head and held of each statement of files(path, content) that isn't empty; content is bytes or text. Runs of white space are one space in both."""
    text = F.col("content").cast("string")
    rows = files.select("path", F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("pos", "t"))
    comment = F.startswith("t", F.lit("--")) | F.startswith("t", F.lit("/*"))
    rows = rows.withColumn("t", F.when(comment, F.lit(" ")).otherwise(F.col("t")))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("number", F.coalesce(F.sum((F.col("t") == ";").cast("int")).over(before), F.lit(0))).where("t <> ';'")
    inside = Window.partitionBy("path", "number").orderBy("pos")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)
    rows = rows.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    opens, closes = (F.col("t") == "(") & (F.col("depth") == 0), (F.col("t") == ")") & (F.col("depth") == 1)
    rows = rows.withColumn("group", F.sum(opens.cast("int")).over(upto)).withColumn("outer", opens | closes | (F.col("depth") <= 0))
    # Brackets first, then the statement: neither gathers more than one statement's text.
    shown = F.when(opens, F.concat(F.lit("("), "group")).otherwise(F.col("t"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), "")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = rows.groupBy("path", "number", "outer", F.when(~F.col("outer"), F.col("group")).alias("group")).agg(joined(shown).alias("text"))
    held = F.transform(F.array_sort(F.collect_list(F.when(~F.col("outer"), F.struct("group", tidy(F.col("text")).alias("text"))))), lambda x: F.struct(x["group"].alias("group"), x["text"].alias("text")))
    out = parts.groupBy("path", "number").agg(F.max(F.when(F.col("outer"), tidy(F.col("text")))).alias("head"), F.map_from_entries(held).alias("held"))
    return out.where("head <> ''")


NAME = r"""("[^"]+"|[A-Za-z_][\w$]*)"""
TABLE = rf"(?:{NAME}\s*\.\s*)?{NAME}"
MAYBE = r"(?:if\s+exists\s+)?"
POLICY = rf"(?is)^(create|drop|alter)\s+policy\s+{MAYBE}{NAME}\s+on\s+{TABLE}\s*(.*)$"
OF_TABLE = rf"(?is)^(create|drop|alter)\s+(?:(?:unlogged|temp|temporary)\s+)?table\s+(?:if\s+(?:not\s+)?exists\s+)?(?:only\s+)?{TABLE}\s*(.*)$"
RENAME = rf"(?is)^rename\s+to\s+{NAME}$"
MOVE = rf"(?is)^set\s+schema\s+{NAME}$"
SECURITY = r"(?is)^(enable|disable)\s+row\s+level\s+security"
CLAUSE_AS, CLAUSE_FOR = r"(?i)\bas\s+(permissive|restrictive)\b", r"(?i)\bfor\s+(all|select|insert|update|delete)\b"
CLAUSE_TO = r"(?i)\bto\s+([\w$\",\s]+?)\s*(?=\busing\b|\bwith\s+check\b|$)"
CLAUSE_USING, CLAUSE_CHECK = r"(?i)\busing\s*\((\d+)", r"(?i)\bwith\s+check\s*\((\d+)"


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), '^"|"$', "")


def _table(schema: Column, table: Column) -> Column:
    return F.struct(F.when(schema == "", "public").otherwise(_bare(schema)).alias("schema"), _bare(table).alias("table"))


def _events(stmts: DataFrame) -> DataFrame:
    """Statements about policies and tables in order: at, path, kind, op, table (schema and table), name, target, and what clauses say (null where they say nothing)."""
    p = lambda n: F.regexp_extract("head", POLICY, n)
    t = lambda n: F.regexp_extract("head", OF_TABLE, n)
    rows = stmts.where(F.col("head").rlike(POLICY) | F.col("head").rlike(OF_TABLE)).withColumn("kind", F.when(F.col("head").rlike(POLICY), "policy").otherwise("table"))
    policy = F.col("kind") == "policy"
    rows = rows.withColumn("verb", F.lower(F.when(policy, p(1)).otherwise(t(1)))).withColumn("name", F.when(policy, _bare(p(2)))).withColumn("of", F.when(policy, _table(p(3), p(4))).otherwise(_table(t(2), t(3)))).withColumn("rest", F.when(policy, p(5)).otherwise(t(4)))
    renames = F.col("rest").rlike(RENAME) & (F.col("verb") == "alter")
    clause = lambda shape: F.when(~renames & F.col("rest").rlike(shape), F.regexp_extract("rest", shape, 1))
    held = lambda shape: F.try_element_at("held", clause(shape).cast("int"))
    to, moves = _bare(F.regexp_extract("rest", RENAME, 1)), F.col("rest").rlike(MOVE)
    roles = F.array_sort(F.transform(F.filter(F.split(clause(CLAUSE_TO), ","), lambda r: F.trim(r) != ""), _bare))
    secure = F.when(~policy & (F.col("verb") == "alter"), F.lower(F.regexp_extract("rest", SECURITY, 1)))
    op = F.when(renames | (~policy & moves), "rename").when(F.col("verb") == "drop", "drop").when(F.col("verb") == "create", F.when(policy, "make").otherwise("found")).otherwise("say")
    target = F.when(~policy & moves, F.struct(_bare(F.regexp_extract("rest", MOVE, 1)).alias("schema"), F.col("of.table").alias("table"))).when(~policy & renames, F.struct(F.col("of.schema").alias("schema"), to.alias("table")))
    rows = rows.select("path", "number", "kind", op.alias("op"), "of", "name", target.alias("to_table"), F.when(renames & policy, to).alias("to_name"), clause(CLAUSE_AS).alias("as"), F.upper(clause(CLAUSE_FOR)).alias("command"), roles.alias("roles"), held(CLAUSE_USING).alias("using"), held(CLAUSE_CHECK).alias("with_check"), F.when(secure != "", secure == "enable").alias("enabled"))
    return rows.withColumn("at", F.struct("path", "number")).drop("number")


def replayed(stmts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The policies that are left (schema, table, name, command, permissive, roles, using, with_check, file) and the tables' security (schema, table, enabled, file).

    Files go in order of their paths. A table is there from its first mention and may be renamed, moved or dropped; its policies go with it. A later policy of the same name replaces an earlier one.
    file is that of the last statement that said something about it.
    """
    events = written(_events(stmts))
    of, left = lives(events.select("at", F.when(F.col("kind") == "table", F.col("op")).otherwise("say").alias("op"), F.col("of").alias("key"), F.col("to_table").alias("target")), implied=True)
    events = written(events.join(of.withColumnRenamed("thing", "owner"), "at").where("owner is not null"))
    tables = written(left.select(F.col("thing").alias("owner"), "key.schema", "key.table"))
    said = events.where("kind = 'policy'")
    key = lambda name: F.struct("owner", F.col(name).alias("name"))
    of, left = lives(said.select("at", "op", key("name").alias("key"), F.when(F.col("to_name").isNotNull(), key("to_name")).alias("target")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    shaped = said.join(of, "at").where("thing is not null").groupBy("thing").agg(*[last(c) for c in ("as", "command", "roles", "using", "with_check")], F.max_by("path", "at").alias("file"))
    rows = left.select("thing", "key.owner", "key.name").join(shaped, "thing").join(tables, "owner")
    policies = rows.select("schema", "table", "name", F.coalesce("command", F.lit("ALL")).alias("command"), (F.coalesce(F.lower("as"), F.lit("permissive")) == "permissive").alias("permissive"), F.coalesce("roles", F.array(F.lit("public"))).alias("roles"), "using", "with_check", "file")
    secured = events.where("enabled is not null").groupBy("owner").agg(F.max_by("enabled", "at").alias("enabled"), F.max_by("path", "at").alias("file")).join(tables, "owner").select("schema", "table", "enabled", "file")
    return policies, secured
