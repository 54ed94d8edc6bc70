"""Entry points, from tables of files, facts and decisions to what a person or a pipeline reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import drift, evaluate, extract, frameworks, imports, journal, normalise, policies, rank, repair, resolve, workspaces
from factweave.operators import report as reports
from factweave.operators.shapes import facts_of
from factweave.sources import markers as m
from factweave.staging import written

KINDS = ("snooze", "tombstone", "rejection")
STRONG = r"(?i)\b(fix|revert|workaround|hotfix|perf|regression|security)\b"
WEAK = r"(?i)\b(because|cap|limit|increase|decrease|switch|migrate|replace|deprecate|tune)\b"


def decisions(log: DataFrame) -> DataFrame:
    """The effective decisions of a log(type, target, at, line_no, content_hash, of): the newest of each type and target that the target's latest revoke does not undo."""
    newest = journal.latest(log.where(F.col("type").isin(*KINDS)), ["type", "target"], "at", "line_no")
    undone = log.where("type = 'revoke'").groupBy("target").agg(F.max_by(F.struct("at", "of"), F.struct("at", "line_no")).alias("_r"))
    rows = newest.join(undone, "target", "left")
    gone = F.col("_r").isNotNull() & (F.col("_r.at") > F.col("at")) & (F.col("_r.of").isNull() | (F.col("_r.of") == F.col("type")))
    return rows.where(~gone).select("type", "target", "content_hash")


def surfaces(facts: DataFrame) -> DataFrame:
    """Facts that count in coverage; facts have an id, a type and a payload."""
    return facts.where(normalise.is_surface(F.col("type"), F.get_json_object("payload", "$.attrs.kind")))


def check(docs: DataFrame, facts: DataFrame, log: DataFrame, failed: DataFrame | None = None, owned: DataFrame | None = None) -> dict[str, DataFrame]:
    """findings, coverage by capability, gaps (markers set aside) and the envelope of docs(doc, text), facts(id, type, payload, hash) and a log of decisions."""
    parsed = m.markers(docs)
    good, gaps = parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").select("doc", "line", "reason")
    found = evaluate.findings(good, facts, decisions(log), failed, owned)
    bound = evaluate.bind_ids(evaluate.asked_binds(good.where("not (kind = 'slot' and hash is null)")), facts, owned)
    counted = surfaces(facts).select("id", normalise.capability_of(F.col("id")).alias("capability"))
    cover = drift.coverage(counted, bound.select(F.col("fact").alias("id")), "id", "capability")
    total = cover.where("capability is null").select("total", "documented", "pct")
    return {"findings": found, "coverage": cover, "gaps": gaps, "envelope": evaluate.envelope(found, total, gaps.select("doc").distinct())}


SCRIPT = r"\.(?:[cm]?[jt]sx?)$"


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (id, capability, type, payload, hash, source), and gaps (capability, file, reason), of files(path, content): routes, names of the environment, packages, policies and models.

    Of several claims of one id the first provider's stands, in that order. Facts that can't be used are gaps of the capability.
    """
    lines = written(extract.lines(files))
    site = lambda c: F.array(F.struct(c.alias("file"), F.lit(None).cast("int").alias("line")))
    code = lines.where(F.col("path").rlike(SCRIPT))
    express = extract.endpoints(code).select("method", F.col("route").alias("path"), "file", F.lit(0).alias("provider"))
    python, lost = imports.python_routes(lines)
    urls = express.unionByName(python.withColumn("provider", F.lit(1))).groupBy("method", "path").agg(F.min(F.struct("provider", "file")).alias("_f"))
    urls = urls.select("method", "path", "_f.provider", site(F.col("_f.file")).alias("source"))
    pages = extract.page_routes(files).select(F.col("route").alias("path"), site(F.col("path")).alias("source"))
    names = extract.env_names(lines).select("name", "read_in_code", F.col("declared").alias("declared_in_example"), F.transform("sites", lambda x: F.struct(x["path"].alias("file"), x["line"].cast("int").alias("line"))).alias("source"))
    members, wrong = workspaces.layout(files.select(F.lit("repository").alias("root"), "path", F.decode("content", "UTF-8").alias("content")))
    rules, secured = policies.replayed(policies.statements(files.where(policies.in_migrations(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("content"))))
    fields = frameworks.model_fields(lines.where(F.col("path").rlike(r"\.prisma$")).withColumnRenamed("path", "file"))
    column = F.struct("line", F.struct("name", "type", "list", "optional", "attrs").alias("c"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"])  # noqa: E731  the fields of one model
    models = fields.where("kind = 'model'").groupBy("file", F.col("block").alias("name")).agg(in_order(F.when(~F.col("relation"), column)).alias("columns"), in_order(F.when(F.col("relation"), column)).alias("relations"))
    enums = fields.where("kind = 'enum'").groupBy("file", F.col("block").alias("name")).agg(F.transform(in_order(column), lambda c: c["name"]).alias("values"))
    tables = [("endpoint", urls), ("route", pages), ("env-var", names), ("package", members), ("policy", rules.withColumn("source", site(F.col("file")))), ("rls", secured.withColumn("source", site(F.col("file"))))]
    tables += [("table", models.withColumn("source", site(F.col("file")))), ("enum", enums.withColumn("source", site(F.col("file"))))]
    claims = [facts_of(rows, kind).withColumn("rank", F.lit(n)) for n, (kind, rows) in enumerate(tables)]
    best = resolve.winners(reduce(DataFrame.unionByName, claims), ["id"], [F.col("rank"), F.col("hash")])
    good, bad = normalise.screened(written(best), ["payload"])
    gap = lambda capability, file, reason: (F.lit(capability).alias("capability") if isinstance(capability, str) else capability.alias("capability"), file.cast("string").alias("file"), reason.alias("reason"))
    gaps = lost.select(*gap("http-endpoints", F.col("file"), F.col("reason"))).unionByName(wrong.select(*gap("workspace-layout", F.col("file"), F.col("kind")))).unionByName(bad.select(*gap(normalise.capability_of(F.col("id")), F.lit(None), F.col("reason"))))
    return good, gaps.distinct()


def report(files: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """From files(path, content) and a log of decisions to the whole report in one step: facts, gaps, findings, coverage, envelope and SARIF results.

    Documents are the Markdown files. gaps holds both what could not be extracted and markers set aside.
    """
    facts, gaps = extracted(files)
    facts = written(facts)
    docs = files.where(F.col("path").rlike(r"(?i)\.md$")).select(F.col("path").alias("doc"), F.decode("content", "UTF-8").alias("text"))
    out = check(docs, facts.select("id", "type", "payload", "hash"), log)
    out["findings"] = written(out["findings"])
    marks = out["gaps"].select(F.lit(None).cast("string").alias("capability"), F.col("doc").alias("file"), "reason")
    results = reports.sarif(out["findings"].withColumn("detail", F.array_join("missing", ", ")))
    return out | {"facts": facts, "gaps": gaps.unionByName(marks), "sarif": results}


def init(facts: DataFrame, documented: DataFrame) -> DataFrame:
    """capability, facts and undocumented of each capability: what a first document would hold. Nothing is written."""
    rows = surfaces(facts).select("id", normalise.capability_of(F.col("id")).alias("capability")).join(documented.select("id", F.lit(1).alias("_d")).distinct(), "id", "left")
    return rows.groupBy("capability").agg(F.count("*").alias("facts"), F.count_if(F.col("_d").isNull()).alias("undocumented"))


def sync(found: DataFrame, facts: DataFrame, renderable: DataFrame) -> DataFrame:
    """Proposals for findings, each dead bind with its nearest survivor. A preview: nothing is patched."""
    lost = found.where("state = 'dead'").select("id", F.explode("missing").alias("_m"))
    near = rank.survivors(lost.select(F.col("_m").alias("id")).distinct(), facts).select(F.col("id").alias("_m"), "candidate", "score")
    first = rank.top(lost.join(near, "_m").select("id", "candidate", "score"), ["id"], [F.desc("score"), F.asc("candidate")], 1).select("id", "candidate", "place")
    return repair.proposals(found, first, renderable)


def noise(log: DataFrame, end: str, days: int = 28) -> DataFrame:
    """applied, rejected, decided and accept_rate of a log(type, at) in the days up to a time; `end` is given, never the clock."""
    at = F.col("at").cast("timestamp")
    rows = journal.trailing(log.where(at.isNotNull()), at, F.lit(end).cast("timestamp"), days)
    return evaluate.accept_rate(rows.agg(F.count_if(F.col("type") == "applied").alias("applied"), F.count_if(F.col("type") == "rejection").alias("rejected")))


def mine(commits: DataFrame) -> DataFrame:
    return rank.mined(commits, STRONG, WEAK)


def interview(subjects: DataFrame, answers: DataFrame, n: int = 5) -> DataFrame:
    """The first open questions of subjects(kind, subject, rank), with the number of all that are open."""
    cards = repair.cards(subjects, answers)
    total = cards.agg(F.count("*").alias("open"))
    return cards.orderBy("place").limit(n).crossJoin(F.broadcast(total))  # one row


def queue(cards: DataFrame) -> DataFrame:
    """line and place: the text of a queue of open questions, for a file that people read."""
    text = F.concat(F.lit("  - qid: "), "qid", F.lit("\n    kind: "), "kind", F.lit("\n    subject: "), F.to_json(F.array("subject")).substr(F.lit(2), F.length(F.to_json(F.array("subject"))) - 2))
    return cards.select(text.alias("line"), "place")
