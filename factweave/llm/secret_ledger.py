"""Secret scans over an incremental ledger of contents.

Every version of every document is addressed by the SHA-256 of its text. The ledger is a table of (blob_id, rule, version, spans): which
rule version has been run over which content, and what it found. A scan takes each content once, however many paths hold it, runs
only the rules whose version the ledger lacks for it, appends the result, and joins the findings back to all rows. Only DataFrame
functions are used; each regular expression is read once more by split() to learn the places of its matches.

Rows: a null text counts as empty; repeated rows, copies and null ids each get their content's findings; other columns pass through
`keep`. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, work_dir, written


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of pattern, of which those stay whose group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# Fixed patterns. access and hex take whole runs, so that their length limit can stand in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob_id string, rule string, version int, spans {SPANS}"


def steps_of(text: Column, rule: Rule) -> Column:
    """Of each match in turn: lengths of the text before it since the last one, of the match, and of its group. Null where the rule doesn't match."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    held = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.arrays_zip(parts.alias("gap"), whole.alias("whole"), held.alias("held"))
    steps = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["held"]).alias("held")))
    return F.when(text.rlike(rule.pattern), steps)


def scan(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: of each distinct content in blobs(blob_id, text), the pairs with a rule version that the ledger lacks.

    Places of matches are running sums over rows of lengths, so time grows with the number of matches, however many one content has.
    """
    blobs = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    known = F.array().cast("array<string>")
    if ledger is not None:
        done = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("_done"))
        blobs = blobs.join(done, "blob_id", "left")
        known = F.coalesce(F.col("_done"), known)
        blobs = blobs.where(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules]), known)) > 0)
    fresh = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), (~F.array_contains(known, f"{r.kind}@{r.version}")).alias("fresh"), steps_of(F.col("text"), r).alias("steps")) for r in rules]
    new = blobs.select("blob_id", F.inline(F.array(*fresh))).where("fresh")
    key = ["blob_id", "rule", "version"]
    rows = new.select(*key, "least", F.posexplode_outer("steps").alias("pos", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.whole")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    span = F.when(F.col("x.held") >= F.col("least"), F.struct((F.col("end") - F.col("x.whole")).alias("start"), F.col("end")))
    return rows.withColumn("end", end).groupBy(*key).agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def ledger_scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, with_stretches: bool = False) -> DataFrame:
    """Columns keep (doc_id alone unless named), blob_id and findings (rule, start, end: by start, then in the order of rules) of every row.

    with_stretches adds stretches (start, end): what the findings cover, in order, findings that overlap as one.
    ledger: the path of a ledger table, appended to; a new one in the shared folder unless given.
    """
    spark = docs.sparkSession
    more = ["stretches"] if with_stretches else []
    row, columns = carried(keep, "blob_id", "findings", *more)
    known = None
    if ledger is None:
        ledger = work_dir(spark)
    else:
        try:
            known = spark.read.schema(LEDGER).parquet(ledger)
        except Exception as e:  # a first scan has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    paths = docs.select(row, text_or_empty().alias("text")).withColumn("blob_id", F.sha2("text", 256))
    scan(paths.select("blob_id", "text"), known, rules).write.mode("append").parquet(ledger)
    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    hits = spark.read.schema(LEDGER).parquet(ledger).where(F.array_contains(current, F.concat_ws("@", "rule", "version")) & (F.size("spans") > 0))
    hits = hits.select("blob_id", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("_n"), F.col("rule").alias("rule"), s["end"].alias("end")))).alias("_s"))
    found = hits.groupBy("blob_id").agg(F.array_sort(F.collect_set("_s")).alias("_found"))
    if with_stretches:
        found = found.join(stretches(hits.select("blob_id", "_s.start", "_s.end")), "blob_id")
    found = written(found)
    # Findings grow with the corpus: never a side to broadcast.
    out = paths.select("_row", "blob_id").join(found.hint("merge"), "blob_id", "left")
    none = F.array().cast("array<struct<rule:string,start:int,end:int>>")
    listed_ = F.coalesce(F.transform("_found", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))), none)
    return out.select(*columns, "blob_id", listed_.alias("findings"), *[F.coalesce(c, F.array().cast(SPANS)).alias(c) for c in more])


def stretches(spans: DataFrame) -> DataFrame:
    """blob_id and stretches of spans(blob_id, start, end): where any of them is, in order. Spans that only touch stay apart.

    A stretch begins where no earlier span reaches beyond; that is a running maximum over rows.
    """
    order = Window.partitionBy("blob_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = rows.groupBy("blob_id", "_n").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("_s"))
    return whole.groupBy("blob_id").agg(F.array_sort(F.collect_list("_s")).cast(SPANS).alias("stretches"))


def listed(findings: str) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def count_of(findings: str, kind: str) -> Column:
    return F.size(F.filter(findings, lambda s: s["rule"] == kind)).cast("bigint")


def redacted(text: Column, stretches: Column, mark: str = "[secret]") -> Column:
    """The text with each of its stretches (start, end; in order, none overlapping) replaced by a mark. Null or no stretches leave the text as it is.

    Pieces are cut from four bytes a character, so that a place is found without counting from the start; that form is made once, as the item of a list.
    """
    n = F.size(stretches)
    piece = lambda wide, a, z: F.decode(F.substring(wide, 4 * a + 1, 4 * (z - a)), "UTF-32")
    ends = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["end"]))
    starts = F.concat(F.transform(stretches, lambda s: s["start"]), F.array(F.length(text)))
    places = F.arrays_zip(ends.alias("a"), starts.alias("z"))
    once = F.transform(F.array(F.encode(text, "UTF-32")), lambda wide: F.array_join(F.transform(places, lambda x: piece(wide, x["a"], x["z"])), mark))
    return F.when(n > 0, once[0]).otherwise(text)
