"""Derived tables kept up to date: what a rule makes of a content is made once, however many files hold it and however often the tree is read.

A store is two tables in a folder: marks(digest, rule, version, run, attempt) of the contents that a rule's version has read, and rows of what it found. A run reads only contents without a mark; its rows
join those kept, by digest. A newer version of a rule starts anew beside the old one. A content that changed while it was read is not marked, so the next run reads it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.staging import written

MARKS = "digest string, rule string, version int, run long, attempt string"


def _table(spark, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # a first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def kept_up(files: DataFrame, store: str, rule: str, version: int, parse: Callable[[DataFrame], DataFrame], run: int = 0, reread: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of parse(files(path, content)) for every file of files(path, content), and path, digest and fresh (read in this run) of each file.

    parse looks at one content at a time and gives rows with a column path, which here names the content. reread(path, content): the same files read once more after parsing; contents that
    it no longer holds give their rows now, but are neither kept nor marked. run grows from run to run.
    """
    spark = files.sparkSession
    digest = F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256)
    named = files.select("path", digest.alias("digest"))
    marks = _table(spark, f"{store}/marks", MARKS).where((F.col("rule") == rule) & (F.col("version") == version)).groupBy("digest").agg(F.min("attempt").alias("attempt"))
    marks, attempt = written(marks), F.lit(uuid.uuid4().hex)
    new = files.withColumn("digest", digest).join(marks, "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))
    new = written(new.select(F.col("digest").alias("path"), "content"))
    made = written(parse(new).withColumnRenamed("path", "digest").withColumn("rule", F.lit(rule)).withColumn("version", F.lit(version)).withColumn("attempt", attempt))
    sure = new.select(F.col("path").alias("digest"))
    if reread is not None:
        sure = sure.join(reread.select(digest.alias("digest")).distinct(), "digest", "left_semi")
    sure = written(sure)
    old = _table(spark, f"{store}/rows", made.schema).where((F.col("rule") == rule) & (F.col("version") == version)).join(marks, ["digest", "attempt"], "left_semi")
    out = written(named.join(old.unionByName(made).drop("rule", "version", "attempt"), "digest").drop("digest"))
    made.join(sure, "digest", "left_semi").write.mode("append").parquet(f"{store}/rows")
    # Marks come last and name the attempt: rows of a run that was broken off have no mark, are never read, and the next run makes them again.
    sure.select("digest", F.lit(rule).alias("rule"), F.lit(version).alias("version"), F.lit(run).cast("long").alias("run"), attempt.alias("attempt")).write.mode("append").parquet(f"{store}/marks")
    fresh = new.select(F.col("path").alias("digest"), F.lit(True).alias("_f"))
    return out, named.join(fresh, "digest", "left").select("path", "digest", F.coalesce("_f", F.lit(False)).alias("fresh"))


def swept(store: str, into: str, live: DataFrame) -> None:
    """A store without the contents that are not among live(digest), written to a folder of its own."""
    spark = live.sparkSession
    live = live.select("digest").distinct()
    for name in ("rows", "marks"):
        spark.read.parquet(f"{store}/{name}").join(live, "digest", "left_semi").write.parquet(f"{into}/{name}")
