"""Replays of ordered logs in which things are made, renamed and dropped, so that what a name means depends on where it stands.

No row loop: each name has a line of marks (something arrives at it or leaves it), every event belongs to what arrived last before it, and a rename links what arrives at the new
name to what it was before. Following those links to their beginning is pointer doubling, so its rounds grow with the logarithm of the longest chain of renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.graph import beginnings
from factweave.staging import written


def lives(events: DataFrame, implied: bool = False) -> tuple[DataFrame, DataFrame]:
    """What each of events(at, op, key, target) is about, and what is left in the end.

    at orders events, is theirs alone and never null; it and the keys are of any type that can be ordered. op: make (the key begins anew, whatever it was), found (it begins if it is not there), rename (to target; what was there is
    replaced), drop, or anything else, which only mentions the key. implied: a key that is mentioned before anything arrives has been there from the start.

    Gives (at, thing) of each event, thing being null where the key means nothing; and (thing, key) of each thing that is still there. A thing is called by the place of the event
    that made it, an implied one by its first key. A rename of what is not there, an error in such logs, leaves nothing at its target, where nothing
    is found anew until it is made or dropped.
    """
    name = F.struct("at", F.lit(None).cast(events.schema["key"].dataType).alias("first"))
    start = F.struct(F.lit(None).cast(events.schema["at"].dataType).alias("at"), F.col("key").alias("first"))
    line = Window.partitionBy("key").orderBy("at", "phase")
    # Phase 0 looks at what is there, phase 1 changes it: what a rename leaves behind and what it arrives at are marks of two keys.
    looks = events.select("key", "at", F.lit(0).alias("phase"), "op")
    leaves = events.where("op in ('drop', 'rename') and not (op = 'rename' and key = target)").select("key", "at", F.lit(1).alias("phase"), F.lit("leave").alias("op"))
    comes = events.where("op in ('make', 'found')").select("key", "at", F.lit(1).alias("phase"), F.concat(F.lit("come "), "op").alias("op"))
    renamed = events.where("op = 'rename' and key <> target").select(F.col("target").alias("key"), "at", F.lit(1).alias("phase"), F.lit("come make").alias("op"))
    rows = looks.unionByName(leaves).unionByName(comes).unionByName(renamed)
    # A key is found anew only where the last mark before is not an arrival.
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda c: F.when(F.col("phase") == 1, c)
    rows = rows.withColumn("_last", F.coalesce(F.last(mark(F.col("op")), ignorenulls=True).over(before), F.lit("come start" if implied else "leave")))
    void = (F.col("op") == "come found") & F.startswith("_last", F.lit("come"))
    rows = written(rows.where(~void).select("key", "at", "phase", "op"))
    arrived = F.when(F.col("phase") == 1, F.when(F.startswith("op", F.lit("come")), F.struct(F.lit(True).alias("there"), name.alias("node"))).otherwise(F.struct(F.lit(False).alias("there"), name.alias("node"))))
    rows = rows.withColumn("_m", F.last(arrived, ignorenulls=True).over(before)).withColumn("_end", F.last(arrived, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = start if implied else F.lit(None)
    node = lambda m: F.when(F.col(m).isNull(), first).when(F.col(f"{m}.there"), F.col(f"{m}.node"))
    found = written(rows.where("phase = 0").select("key", "at", node("_m").alias("node")))
    # What a rename brings was something else before: from there to the beginning.
    steps = events.where("op = 'rename' and key <> target").select("at").join(found.select("at", F.col("node").alias("parent")), "at").select(name.alias("node"), "parent")
    made = events.where("op in ('make', 'found')").select(name.alias("node"), name.alias("parent"))
    begun = found.where("node.at is null and node is not null").select("node", F.col("node").alias("parent")).distinct()
    roots = written(beginnings(steps.unionByName(made).unionByName(begun)))
    # A 'found' or 'make' event is about what it makes; one that found its key there is about that.
    own = events.where("op = 'make'").select("at", name.alias("node"))
    anew = rows.where("phase = 1 and op = 'come found'").select("at", name.alias("node"))
    own = own.unionByName(anew)
    about = found.join(own.select("at").distinct(), "at", "left_anti").select("at", "node").unionByName(own)
    things = about.join(roots, "node", "left").select("at", F.col("root").alias("thing"))
    last = rows.groupBy("key").agg(F.max_by("_end", F.struct("at", "phase")).alias("_end"))
    left = last.withColumn("node", node("_end")).where("node is not null").join(roots, "node").where("root is not null").select(F.col("root").alias("thing"), "key")
    return things, left
