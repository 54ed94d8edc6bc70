"""The whole check: markers of documents against facts and the log of decisions, from binds to states, coverage and the report.

markers(doc, line, kind, id, binds, hash, content, body): as sources.markers gives them, without those set aside.
facts(id, hash): hashes in full. log(type, target, content_hash): the effective decisions, of types snooze, tombstone and rejection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.operators import binds as b
from factweave.operators import drift
from factweave.operators.normalise import capability_of

PACKAGE = r"^pkg:([^#]+)#([^/]+)/\*$"
TOP, TRIMMED, MOST_BYTES = 20, 5, 8192
KEY = ["kind", "id", "doc", "line"]


def asked_binds(markers: DataFrame) -> DataFrame:
    """kind, id, doc, line and raw of every bind; regions without binds have those of the anchor with the longest dotted part of their id."""
    bare = markers.where((F.col("kind") != "anchor") & (F.size("binds") == 0)).select(*KEY)
    anchors = markers.where("kind = 'anchor'").groupBy(F.col("id").alias("anchor_id")).agg(F.first("binds").alias("binds"))
    heirs = b.inherited(bare, anchors).select(*KEY, "binds")
    own = markers.where(F.size("binds") > 0).select(*KEY, "binds")
    return own.unionByName(heirs).select(*KEY, F.explode("binds").alias("raw"))


def resolved(asked: DataFrame, facts: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Each bind with every fact it names: by its id, by a prefix before a star, or by package and capability of owned(id, package, capability).

    fact is null where there is none. lacking marks binds that name something that isn't there: an id, or a package that owns nothing; an empty prefix is no lack.
    """
    known = facts.select("id")
    prefix = F.col("raw").endswith("*")
    package = F.col("raw").rlike(PACKAGE)
    one = asked.where(~prefix).join(known.select(F.col("id").alias("fact")), F.col("raw") == F.col("fact"), "left").withColumn("lacking", F.col("fact").isNull())
    some = asked.where(prefix & ~package).select(*[F.col(k).alias(f"_{k}") for k in KEY], "raw", F.expr("left(raw, length(raw) - 1)").alias("prefix"))
    met = b.by_prefix(some.select("prefix").distinct(), known).select("prefix", F.col("id").alias("fact"))
    some = some.join(met, "prefix", "left").select(*[F.col(f"_{k}").alias(k) for k in KEY], "raw", "fact", F.lit(False).alias("lacking"))
    out = one.unionByName(some)
    if owned is not None:
        scope = asked.where(package).withColumn("package", F.regexp_extract("raw", PACKAGE, 1)).withColumn("capability", F.regexp_extract("raw", PACKAGE, 2))
        there = owned.select("package").distinct().withColumn("_there", F.lit(True))
        held = owned.select("package", "capability", F.col("id").alias("fact"))
        scope = scope.join(held, ["package", "capability"], "left").join(there, "package", "left").withColumn("lacking", F.col("_there").isNull())
        out = out.unionByName(scope.select(*KEY, "raw", "fact", "lacking"))
    return out


def bind_ids(asked: DataFrame, facts: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """kind, id, doc, line and fact: the different facts of each marker, whichever way its binds name them."""
    return resolved(asked, facts, owned).where("fact is not null").select(*KEY, "fact").distinct()


def findings(markers: DataFrame, facts: DataFrame, log: DataFrame, failed: DataFrame | None = None, owned: DataFrame | None = None) -> DataFrame:
    """doc, line, kind, id, state and missing (binds that name nothing, in order) of every marker but slots that were never filled; in no order.

    failed(capability): those whose facts could not be read. The hash of a marker's facts is that of one text, so the ids and hashes of its facts make one row.
    """
    markers = markers.where("not (kind = 'slot' and hash is null)")
    rows = resolved(asked_binds(markers), facts, owned).withColumn("capability", capability_of(F.regexp_replace("raw", "^pkg:[^#]+#", "")))
    bad = F.lit(False)
    if failed is not None:
        rows = rows.join(failed.select("capability", F.lit(True).alias("_bad")).distinct(), "capability", "left")
        bad = F.coalesce("_bad", F.lit(False))
    buried = log.where("type = 'tombstone'").select(F.col("target").alias("raw"), F.lit(True).alias("_buried")).distinct()
    rows = rows.join(facts.select(F.col("id").alias("fact"), F.col("hash").alias("_hash")), "fact", "left").join(buried, "raw", "left").withColumn("_bad_", bad)
    lack = F.col("lacking") & ~F.col("_bad_")
    pair = F.when(F.col("fact").isNotNull() & ~F.col("_bad_"), F.struct(F.col("fact").alias("id"), F.col("_hash").alias("hash")))
    held = rows.groupBy(*KEY).agg(F.bool_or("_bad_").alias("_failed"), F.array_sort(F.collect_set(F.when(lack, F.col("raw")))).alias("missing"), F.collect_set(F.when(lack & F.col("_buried"), F.col("raw"))).alias("_gone"), F.collect_set(pair).alias("_pairs"))
    word = lambda kind, name, value: log.where(F.col("type") == kind).groupBy(F.col("target").alias("id")).agg(value.alias(name))
    rows = markers.join(held, KEY, "left").join(word("snooze", "_snoozed", F.lit(True)), "id", "left").join(word("rejection", "_refused", F.max("content_hash")), "id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("missing", F.coalesce("missing", none)).withColumn("_facts", canon.aggregate_hash(F.coalesce("_pairs", F.array().cast("array<struct<id:string,hash:string>>")))).withColumn("_body", canon.full_hash(canon.normal_body(F.coalesce("body", F.lit("")))))
    # A refusal holds for the state that was refused: of the text if that is what differs, else of the facts.
    edited = (F.col("kind") == "gen") & F.col("content").isNotNull() & (canon.match(F.col("content"), F.col("_body")) == "differ")
    refused = F.col("_refused") == canon.display(F.when(edited, F.col("_body")).otherwise(F.col("_facts")))
    content = F.when(F.col("kind") == "gen", F.col("content"))
    state = drift.state(snoozed=F.col("_snoozed"), failed=F.col("_failed"), n_missing=F.size("missing"), n_tombstoned=F.size(F.coalesce("_gone", none)), kind=F.col("kind"), recorded=F.col("hash"), current=F.col("_facts"), content=content, body=F.col("_body"), held=refused)
    return rows.select("doc", "line", "kind", "id", state.alias("state"), "missing")


LOCALE = "UNICODE"  # the root order of ICU, as people read names


def place_of(*names: str) -> list[Column]:
    """Columns to order by: texts in the order of ICU, and by code point where that sees no difference."""
    return [*[F.collate(F.col(n), LOCALE) if n != "line" else F.col(n) for n in names], *[F.col(n) for n in names if n != "line"]]


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*place_of("doc", "line", "id"))


def classify(drifted: DataFrame, bound: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds self_caused to findings(kind, id, doc, line): whether the document is among docs(doc), or a fact of it, or one it misses, among ids(fact).

    bound(kind, id, doc, line, fact) holds both the facts a marker names and those it misses.
    """
    hit = bound.join(ids.select("fact").distinct(), "fact", "left_semi").select(*KEY).distinct().withColumn("_fact", F.lit(True))
    rows = drifted.join(docs.select("doc", F.lit(True).alias("_doc")).distinct(), "doc", "left").join(hit, KEY, "left")
    return rows.withColumn("self_caused", F.coalesce("_doc", F.lit(False)) | F.coalesce("_fact", F.lit(False))).drop("_doc", "_fact")


def unscanned(markers: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc, anchors and regions of documents with markers that are not among scanned(doc)."""
    rest = markers.join(scanned.select("doc").distinct(), "doc", "left_anti")
    return rest.groupBy("doc").agg(F.count_if(F.col("kind") == "anchor").alias("anchors"), F.count_if(F.col("kind") != "anchor").alias("regions"))


def capped(rows: DataFrame, key: list[str], order: list[Column], n: int = TOP) -> DataFrame:
    """The first n items of each channel, each with the number of all its items."""
    everything = Window.partitionBy(*key)
    return rows.withColumn("total", F.count("*").over(everything)).withColumn("place", F.row_number().over(everything.orderBy(*order))).where(F.col("place") <= n)


def envelope(found: DataFrame, coverage: DataFrame, unreadable: DataFrame | None = None, top: int = TOP, most: int = MOST_BYTES) -> DataFrame:
    """One row: ok, code, summary (300 characters at most), truncated, and data as JSON: counts by state, coverage, and the first findings that are drift, in order.

    coverage(total, documented, pct) is one row; unreadable(doc) takes the verdict away if it has any. JSON longer than `most` characters is made anew of five findings.
    """
    drifted = F.col("state").isin(*drift.DRIFT)
    counts = found.agg(F.count("*").alias("n"), F.count_if(drifted).alias("drift"), *[F.count_if(F.col("state") == s).alias(s) for s in (*drift.DRIFT, "clean")])
    first = in_order(found.where(drifted).select("doc", "line", "id", "state", "missing")).limit(top)
    shown = F.struct("doc", "line", "id", "state", "missing")
    sorted_ = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{n}") for n, c in enumerate(place_of("doc", "line", "id"))], shown.alias("shown"))))
    first = first.agg(F.transform(sorted_, lambda x: x["shown"]).alias("_top"))
    bad = (unreadable if unreadable is not None else found.sparkSession.createDataFrame([], "doc string")).agg(F.count("*").alias("bad"))
    row = counts.crossJoin(F.broadcast(coverage.select("total", "documented", "pct"))).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(bad))  # one row each
    code = F.when(F.col("bad") > 0, "UNREADABLE").when(F.col("drift") > 0, "DRIFT_FOUND").otherwise("CLEAN")
    ratio = F.when(F.col("pct").isNull(), "no facts").otherwise(F.format_string("%d/%d surfaces documented (%d%%)", "documented", "total", "pct"))
    text = F.concat(F.format_string("%d drift finding(s) [stale %d, dead %d, tampered %d]; %d clean; ", "drift", "stale", "dead", "tampered", "clean"), ratio)
    text = F.substring(F.when(F.col("bad") > 0, F.format_string("%d unreadable document(s) - no verdict", "bad")).otherwise(text), 1, 300)
    data = lambda items: F.to_json(F.struct(F.struct(*drift.DRIFT, "clean").alias("counts"), F.struct("total", "documented", "pct").alias("coverage"), items.alias("top")))
    row = row.withColumn("code", code).withColumn("summary", text).withColumn("_long", data(F.col("_top"))).withColumn("_cut", F.length("_long") > most)
    data_ = F.when(F.col("_cut"), data(F.slice("_top", 1, TRIMMED))).otherwise(F.col("_long"))
    return row.select((F.col("code") == "CLEAN").alias("ok"), "code", "summary", (F.col("_cut") | (F.col("n") > F.size("_top"))).alias("truncated"), data_.alias("data"))


def write_report(found: DataFrame, path: str) -> None:
    """All findings as JSON lines, in order of document, line and id within and across files."""
    found.repartitionByRange(*place_of("doc", "line", "id")).sortWithinPartitions(*place_of("doc", "line", "id")).write.mode("overwrite").json(path)


def accept_rate(counts: DataFrame) -> DataFrame:
    """Adds decided and accept_rate, to three digits, of counts(applied, rejected); null where nothing was decided."""
    both = F.col("applied") + F.col("rejected")
    return counts.withColumn("decided", both).withColumn("accept_rate", F.when(both > 0, F.round(F.col("applied") / both, 3)))
