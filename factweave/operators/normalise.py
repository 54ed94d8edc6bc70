"""From raw rows to facts: payloads, ids and hashes, and what is set aside on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.functions.text import in_scope

COMMENT = "<!--|-->"


def capability_of(id_: Column) -> Column:
    """The axis that an id belongs to: symbols have a spelling of their own."""
    return F.when(F.startswith(id_, F.lit("ds ")), "module-graph").otherwise(F.split_part(F.regexp_replace(id_, "^fact:", ""), F.lit("/"), F.lit(1)))


def facts(rows: DataFrame, kind: str, id_: Column, attrs: dict[str, Column], source: Column | None = None) -> DataFrame:
    """id, capability, type, payload, hash and source of each row. The payload is canonical; a source never changes the hash."""
    inner = F.struct(*[c.alias(k) for k, c in sorted(attrs.items())])
    payload = canon.canonical(attrs=inner, schema_version=F.lit(1), type=F.lit(kind))
    empty = F.array().cast("array<struct<file:string,line:int>>")
    out = rows.select(id_.alias("id"), F.lit(kind).alias("type"), payload.alias("payload"), (empty if source is None else source).alias("source"))
    return out.select("id", capability_of(F.col("id")).alias("capability"), "type", "payload", canon.full_hash(F.col("payload")).alias("hash"), "source")


def screened(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts that can be used, and gaps(id, reason): those without an id or a required column, or that would break out of a comment."""
    lacks = F.lit(False)
    for c in ["id", *required]:
        lacks = lacks | F.col(c).isNull()
    reason = F.when(lacks, "malformed").when(F.col("id").rlike(COMMENT) | F.col("payload").rlike(COMMENT), "holds a comment mark")
    marked = rows.withColumn("_why", reason)
    return marked.where("_why is null").drop("_why"), marked.where("_why is not null").select("id", F.col("_why").alias("reason")).distinct()


def scoped(rows: DataFrame, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts with the sources that lie in scope; those whose sources all lie outside are left out and counted. A fact without sources stays."""
    inside = F.filter("source", lambda s: ~in_scope(s["file"], excluded))
    marked = rows.withColumn("_in", inside)
    gone = (F.size("source") > 0) & (F.size("_in") == 0)
    return marked.where(~gone).withColumn("source", F.col("_in")).drop("_in"), marked.where(gone).agg(F.count("*").alias("scoped_out"))


def undeclared(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """provider and type of facts that a provider emits without declaring the type; any row fails the provider's capability."""
    return rows.select("provider", "type").distinct().join(declared, ["provider", "type"], "left_anti")


def is_surface(type_: Column, kind: Column) -> Column:
    """Facts that count in coverage: not churn, packages, modules or symbols, nor services that others own."""
    return ~type_.isin("churn", "package", "module", "symbol", "rls") & ~((type_ == "service") & F.coalesce(kind == "external", F.lit(False)))


def detected(rules: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Providers that apply: rules(provider, kind, value) of kind always, file (a name), dir (a leading folder) or dep."""
    names = files.select(F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("value"))
    dirs = files.select(F.lit("dir"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))))
    present = names.union(dirs).union(dependencies.select(F.lit("dep"), "name")).distinct()
    return rules.where("kind = 'always'").select("provider").union(rules.join(present, ["kind", "value"], "left_semi").select("provider")).distinct()


def unknown_entities(prose: DataFrame, known: DataFrame) -> DataFrame:
    """id and token of names in code marks that no known(token) explains."""
    tokens = prose.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`\\s]+)`"), F.lit(1)))).alias("token"))
    return tokens.join(known, "token", "left_anti")


def first_difference(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """path and reason of the first file, by path, that was added, is gone or has another digest."""
    a, b = recorded.select("path", F.col("digest").alias("_a")), present.select("path", F.col("digest").alias("_b"))
    reason = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full_outer").withColumn("reason", reason).where("reason is not null").orderBy("path").limit(1).select("path", "reason")


def requirements(needs: DataFrame) -> DataFrame:
    """For each requirement that is not met of needs(provider, requirement, met, live): who needs it, and whether only live providers do."""
    return needs.where("not met").groupBy("requirement").agg(F.array_sort(F.collect_set("provider")).alias("providers"), F.bool_and("live").alias("only_live"))


def set_hash(rows: DataFrame, id_: str, version: str, most: int = 100_000) -> DataFrame:
    """16 digits of the hash of the sorted set of id@version. It is one text of a list of providers; a set of more than `most` is an error."""
    each = rows.select(F.concat_ws("@", id_, version).alias("_v")).distinct()
    every = F.array_join(F.array_sort(F.collect_list("_v")), ",")
    checked = F.when(F.count("*") <= most, F.substring(F.sha2(every, 256), 1, 16)).otherwise(F.raise_error(F.lit(f"more than {most} versions")))
    return each.limit(most + 1).agg(checked.alias("hash"))


def tail(id_: Column) -> Column:
    """The part of a symbol's id after its last slash."""
    return F.element_at(F.split(id_, "/"), -1)


def tail_candidates(missing: DataFrame, facts_: DataFrame, n: int = 3) -> DataFrame:
    """missing(id) with up to n facts of the same tail, by id. Of each tail only the first n + 1 facts are joined, as one of them may be the missing id itself."""
    first = Window.partitionBy("_t").orderBy("candidate")
    named = facts_.select(F.col("id").alias("candidate"), tail(F.col("id")).alias("_t")).distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n + 1).drop("_n")
    pairs = missing.select(F.col("id"), tail(F.col("id")).alias("_t")).join(named, "_t").where("id <> candidate")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("candidate"))).where(F.col("place") <= n).select("id", "candidate", "place")


def arity(signature: Column) -> Column:
    """Parameters between the first parentheses."""
    inside = F.trim(F.regexp_extract(signature, r"\(([^()]*)\)", 1))
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, ",")))


def migration_key(name: Column) -> Column:
    """Order of migrations: numbered ones (V12__x) by number, then all others by name."""
    number = F.regexp_extract(name, r"^V(\d+)", 1)
    return F.struct((number == "").alias("other"), F.when(number != "", number.cast("bigint")).alias("number"), name.alias("name"))


def newest(rows: DataFrame, key: list[str], order: str, live: DataFrame, factor: int = 2) -> DataFrame:
    """Of each provider's cache rows(key, digest, order) those of live(key, digest), and of them the newest, factor times as many as live digests, one at least."""
    alive = live.select(*key, "digest").distinct()
    held = rows.join(alive, [*key, "digest"], "left_semi").join(alive.groupBy(*key).agg(F.count("*").alias("_live")), key)
    return held.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_n") <= F.greatest(F.col("_live") * factor, F.lit(1))).drop("_n", "_live")
