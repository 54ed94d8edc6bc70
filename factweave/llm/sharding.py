"""Shards by balanced label propagation: copies of a text are linked, and move towards the shards that hold most of their links.

Law "rows": shard sizes differ by one row at most. The first shards are dealt in turn by a gapless number. Then rounds of joins
follow, as long as a round cuts fewer links than the one before; each keeps every shard's number of rows as it is:

- each class of linked rows prefers the shard that holds most of it, or as many such shards as it fills alone;
- rows elsewhere ask to move there; the requests of two shards to each other are matched one to one;
- a surplus in one direction is paid back with unlinked rows of the shard that gains, as far as it has any (its quota).

So what travels between tasks is one row per document, and tables of one row per pair of shards. Rows are picked by running numbers
within many small buckets and offsets of the buckets, never within a whole shard or class. Only DataFrame functions are used.

Rows: a null text counts as empty, and empty texts are linked as other equal ones; repeated rows and null ids are rows like others.
Other columns pass through `keep`. Fewer rows than shards leave shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import carried, text_or_empty, written

SHARDS = 40
BUCKET_ROWS = 4096  # rows of a shard that one window sorts, about


def numbered(rows: DataFrame) -> DataFrame:
    """Adds n, gapless from 0, by Spark's ids, which are gapless within each partition; rows must be a written table with such an id."""
    part = F.shiftright("id", 33)
    counts = rows.groupBy(part.alias("_part")).count()
    first = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = written(counts.select("_part", first.alias("_first")))  # one row per partition of the input
    return rows.join(first, part == first["_part"]).withColumn("n", F.col("_first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first")


def positions(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Adds at: each row's gapless position from 0 within its key, by numbers within buckets of a key and the sizes of earlier buckets."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(*by, "_b").count()
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.select(*by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("id")) - 1)
    return own.join(sizes, [*by, "_b"]).withColumn("at", F.col("_before") + F.col("_k")).drop("_b", "_before", "_k")


def preferred(linked: DataFrame, shards: int, room: int) -> DataFrame:
    """g, h and targets: for each class, the shards that hold most of it, as many as it fills.

    A class of more rows than a shard claims the shards that it fills alone, and all other classes turn to shards that no one has claimed.
    """
    held = linked.groupBy("g", "h", "shard").count()  # a row per class and shard
    whole = Window.partitionBy("g", "h")
    order = whole.orderBy(F.desc("count"), F.xxhash64("g", "h", "shard"), "shard")
    held = written(held.withColumn("rank", F.row_number().over(order)).withColumn("fills", F.sum("count").over(whole) / max(1, room)))
    claims = held.where("rank <= floor(fills)").select("shard").distinct()
    claimed = sorted(r.shard for r in claims.collect())  # no more than there are shards
    free = [s for s in range(shards) if s not in claimed] or list(range(shards))
    rank = F.row_number().over(whole.orderBy(F.col("shard").isin(claimed), "rank"))
    large, small = held.where("fills >= 1"), held.where("fills < 1")
    large = large.where("rank <= ceil(fills)").groupBy("g", "h").agg(F.array_sort(F.collect_list("shard")).alias("targets"))
    some = F.element_at(F.array(*map(F.lit, free)), (F.pmod(F.xxhash64("g", "h"), F.lit(len(free))) + 1).cast("int"))
    home = F.when(F.col("shard").isin(claimed), some).otherwise(F.col("shard")) if claimed else F.col("shard")
    small = small.withColumn("first", rank).where("first = 1").select("g", "h", F.array(home).alias("targets"))
    return large.unionByName(small)


def quotas(asked: DataFrame, spare: DataFrame) -> DataFrame:
    """(here, there, admitted, paid) for each pair of shards: rows that may go from here to there, and unlinked rows that go back for them.

    asked: (here, there, count), spare: (shard, count) of unlinked rows. At most a row for each pair of shards.
    """
    back = asked.select(F.col("there").alias("here"), F.col("here").alias("there"), F.col("count").alias("back"))
    pairs = asked.join(back, ["here", "there"], "left").fillna(0, ["back"]).withColumn("surplus", F.greatest(F.col("count") - F.col("back"), F.lit(0)))
    pairs = pairs.join(spare.select(F.col("shard").alias("there"), F.col("count").alias("spare")), "there", "left").fillna(0, ["spare"])
    due = F.sum("surplus").over(Window.partitionBy("there"))
    paid = F.when(due <= F.col("spare"), F.col("surplus")).otherwise(F.floor(F.col("surplus") * F.col("spare") / due))
    pairs = pairs.withColumn("paid", paid.cast("bigint"))
    return pairs.select("here", "there", (F.least("count", "back") + F.col("paid")).alias("admitted"), "paid")


def propagate(linked: DataFrame, single: DataFrame, shards: int, room: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """One round over linked(id, g, h, shard) and single(id, shard): both anew."""
    targets = written(preferred(linked, shards, room))
    wish = linked.join(targets, ["g", "h"]).withColumn("there", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(F.element_at("targets", (F.pmod(F.xxhash64("id"), F.size("targets")) + 1).cast("int"))))
    wish = written(wish.select("id", "g", "h", F.col("shard").alias("here"), "there"))
    moving = wish.where("here <> there")
    quota = written(quotas(moving.groupBy("here", "there").count(), single.groupBy("shard").count()))
    moved = positions(moving, ["here", "there"], buckets).join(quota, ["here", "there"])
    moved = moved.select("id", "g", "h", F.when(F.col("at") < F.col("admitted"), F.col("there")).otherwise(F.col("here")).alias("shard"))
    after = written(wish.where("here = there").select("id", "g", "h", F.col("here").alias("shard")).unionByName(moved))
    # The unlinked rows of a shard go back by position: the first so many to one shard, the next to another.
    upto = F.sum("paid").over(Window.partitionBy("there").orderBy("here"))
    ways = quota.where("paid > 0").withColumn("upto", upto).groupBy(F.col("there").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("upto", "here"))).alias("ways"))
    placed = positions(single, ["shard"], buckets).join(written(ways), "shard", "left")
    goes = F.filter("ways", lambda w: F.col("at") < w["upto"])
    rest = written(placed.select("id", F.when(F.size(goes) > 0, F.get(goes, F.lit(0))["here"]).otherwise(F.col("shard")).alias("shard")))
    return after, rest


def cut_of(linked: DataFrame) -> int:
    """Links between rows of a class that lie in different shards, counted by classes and shards."""
    held = linked.groupBy("g", "h", "shard").agg(F.count("*").cast("decimal(38,0)").alias("c"))
    held = held.groupBy("g", "h").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    return int(held.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("squares")), F.lit(0))).first()[0]) // 2


def assign(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None, cuts: list[int] | None = None) -> DataFrame:
    """Columns keep (doc_id alone unless named), size, text_crc32, law, shard, slot and grown_shard of every row. The cut links before and after each round are appended to cuts."""
    row, columns = carried(keep, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = text_or_empty()
    rows = docs.select(row, (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.xxhash64(F.lit(1), text).alias("h"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()))
    total = rows.count()
    buckets = max(8, -(-total // (shards * BUCKET_ROWS)))
    dealt = numbered(rows.select("id", "g", "h")).withColumn("shard", (F.col("n") % shards).cast("int"))
    classes = written(rows.groupBy("g", "h").agg(F.count("*").alias("rows")).where("rows > 1"))
    dealt = written(dealt.join(classes, ["g", "h"], "left").select("id", "g", "h", "shard", F.col("rows").isNotNull().alias("linked")))
    linked, single = dealt.where("linked").select("id", "g", "h", "shard"), dealt.where("not linked").select("id", "shard")
    cuts = [] if cuts is None else cuts
    cuts.append(cut_of(linked))
    while cuts[-1]:
        after = propagate(linked, single, shards, total // shards, buckets)
        cuts.append(cut_of(after[0]))
        if cuts[-1] >= cuts[-2]:
            break
        linked, single = after
    final = positions(linked.select("id", "shard").unionByName(single), ["shard"], buckets)
    out = rows.join(final, "id")
    return out.select(*columns, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("at").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame, text: Column) -> DataFrame:
    """links between equal texts, and cut: those between shards. Counted by classes, not by pairs."""
    held = assigned.groupBy(F.xxhash64(text).alias("g"), "shard").count()
    held = held.groupBy("g").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("kept"))
    return held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("links"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("kept")).alias("cut"))
