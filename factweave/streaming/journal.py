"""The log of decisions as a stream: what holds of each target, kept as state and written as it changes.

State is keyed by target and holds the newest entry of each type, a handful, whatever the order in which lines arrive: an old line that comes late changes nothing, and a late revoke undoes what it
should have undone. Each change is a row of a table whose folders are named by the batch and written over when a batch runs again, so a restart neither loses nor repeats any.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ENTRY = "at string, line_no long, of string, content_hash string, expires string"
CHANGE = f"target string, type string, {ENTRY}, active boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that keeps maps of a key


def folded(log: DataFrame) -> DataFrame:
    """Newest entry of each (type, target) of log(type, target, at, line_no); of equal times the lowest line. Works on streams and tables alike."""
    order = F.struct(F.col("at"), (-F.col("line_no")).alias("first"))
    return log.groupBy("type", "target").agg(F.max_by(F.struct("at", "line_no"), order).alias("_e")).select("type", "target", "_e.at", "_e.line_no")


class Decisions(StatefulProcessor):
    """The newest entry of each type of one target; gives all of them again, revokes apart, when one has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "type string", ENTRY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        changed = False
        for r in rows:
            old, new = held.get(r.type), (r.at, r.line_no, r.of, r.content_hash, r.expires)
            if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                held[r.type] = new
                self.entries.updateValue((r.type,), new)
                changed = True
        revoke = held.get("revoke")
        for kind, e in held.items() if changed else ():
            if kind != "revoke":
                yield Row(target=key[0], type=kind, at=e[0], line_no=e[1], of=e[2], content_hash=e[3], expires=e[4], active=not (revoke and revoke[2] == kind and revoke[0] > e[0]))

    def close(self) -> None:
        pass


def changes(log: DataFrame) -> DataFrame:
    """Of each target that a batch of log(type, target, at, line_no, of, content_hash, expires) changes, every decision and whether it is active. Lines without type, target or time say nothing."""
    rows = log.where("type is not null and target is not null and at is not null").select("target", "type", "at", F.coalesce(F.col("line_no").cast("long"), F.lit(0)).alias("line_no"), "of", "content_hash", "expires")
    return rows.groupBy("target").transformWithState(statefulProcessor=Decisions(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def follow(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of a stream of decisions to the table's folder, one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def standing(spark: SparkSession, table: str, now: str | None = None) -> DataFrame:
    """target, type, at, line_no, of, content_hash and expires of the decisions that hold by the newest batch of each; expired ones don't at the time now, if it is given."""
    rows = spark.read.schema(f"{CHANGE}, batch long").parquet(table)
    last = Window.partitionBy("target", "type").orderBy(F.desc("batch"))
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1 and active")
    if now is not None:
        rows = rows.where(F.col("expires").isNull() | (F.col("expires") > now))
    return rows.drop("_n", "batch", "active")


def late_counts(events: DataFrame, at: str, delay: str, window: str) -> DataFrame:
    """Counts by time window for events that are at most `delay` late."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
