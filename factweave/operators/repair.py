"""What to do about findings: repair proposals, questions for people, sections to add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("removal", "rationale", "document")


def proposals(findings: DataFrame, candidates: DataFrame, renderable: DataFrame) -> DataFrame:
    """id and kind of repair of findings(id, kind, state), with the first of candidates(id, candidate, place) for what died.

    Prose is rewritten by its author; a generated region is made anew if renderable(id) holds it; a dead binding goes to its nearest survivor or gets a tombstone.
    """
    first = candidates.where("place = 1").select("id", "candidate")
    rows = findings.join(first, "id", "left").join(renderable.select("id", F.lit(True).alias("_r")).distinct(), "id", "left")
    open_ = F.col("state").isin("stale", "tampered", "unverified")
    made = F.when(~F.coalesce("_r", F.lit(False)), "unrenderable").when(F.col("state") == "tampered", "restore").otherwise("regenerate")
    repair = F.when((F.col("kind") == "slot") & F.col("state").isin("stale", "unverified"), "reprose").when((F.col("kind") == "gen") & open_, made)
    repair = repair.when((F.col("state") == "dead") & F.col("candidate").isNotNull(), "rebind").when(F.col("state") == "dead", "tombstone")
    return rows.withColumn("repair", repair).where("repair is not null").select("id", "state", "repair", F.when(F.col("repair") == "rebind", F.col("candidate")).alias("candidate"))


def question_id(kind: str, subject: str):
    """iv- and 12 digits of a hash of kind and subject."""
    return F.concat(F.lit("iv-"), F.substring(F.sha2(F.concat(F.col(kind), F.lit("\0"), F.col(subject)), 256), 1, 12))


def cards(subjects: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, kind, subject and place of the questions still open: subjects(kind, subject, rank), the first of repeats; answers(qid, verdict) settle them, except unknown, which puts them last in their kind."""
    once = subjects.groupBy("kind", "subject").agg(F.min("rank").alias("rank")).withColumn("qid", question_id("kind", "subject"))
    rows = once.join(answers, "qid", "left").where("verdict is null or verdict = 'unknown'")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = Window.orderBy(kind, F.col("verdict").isNotNull(), "rank", "subject")  # a list for one person to read
    return rows.select("qid", "kind", "subject", F.row_number().over(order).alias("place"))


def upgrade(recipe: DataFrame, present: DataFrame) -> DataFrame:
    """Sections of recipe(doc, section, ids, place) none of whose ids is in present(doc, id), each with the nearest earlier section of its document that is."""
    rows = recipe.select("doc", "section", "place", F.explode("ids").alias("id")).join(present.select("doc", "id", F.lit(1).alias("_in")).distinct(), ["doc", "id"], "left")
    state = rows.groupBy("doc", "section", "place").agg((F.count("_in") > 0).alias("have"))
    before = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("after_section", F.last(F.when(F.col("have"), F.col("section")), ignorenulls=True).over(before))
    return state.where("not have").select("doc", "section", "after_section")
