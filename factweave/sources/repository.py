"""Tables from a repository: files, logs, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.text import in_scope

SKIPPED = (".git", "node_modules", "dist", "build", "vendor", "__pycache__")
JOURNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "target", "at", "actor", "expires", "content_hash", "of", "to", "marker", "evidence", "action", "_bad")])
CLAIMS = "id string, capability string, provider string, confidence string, type string, payload string, hash string"
STRETCH = 100_000  # lines
SECRET_NAME = r"(?i)(^|/)(\.env(\.[^/]*)?|[^/]*\.(pem|key|p12|pfx|keystore)|id_(rsa|dsa|ed25519)|credentials(\.[^/]*)?)$"
EXAMPLE_NAME = r"(?i)\.(example|sample|template)$"


def is_secret(path: Column) -> Column:
    """Names under which credentials are kept; examples of them are not."""
    return path.rlike(SECRET_NAME) & ~path.rlike(EXAMPLE_NAME)


def files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """path (below root), size, digest and content of the files of a tree, without skipped folders, secrets and the checkouts named in nested.

    Spark's listing leaves out names that start with a dot or underscore; so nested checkouts can't be told by their .git and have to be named.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^\w+:/*", "/")
    base = F.lit(root.split(":", 1)[-1].rstrip("/").replace("//", "/") + "/")
    rows = raw.withColumn("path", F.substring(path, F.length(base) + 1, F.length(path)))
    rows = rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED)) & ~is_secret(F.col("path")))
    if include:
        rows = rows.where(in_scope(F.col("path"), include))
    if exclude or nested:
        rows = rows.where(~in_scope(F.col("path"), [*(exclude or []), *(nested or [])]))
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), "content")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no of a text file; numbers follow the file's order. Lines are numbered within the blocks in which Spark reads the file, and the blocks' counts added up."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_block").orderBy("_id")))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_c")).select("_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return own.join(blocks, "_block").select("value", (F.col("_before") + F.col("_n")).cast("int").alias("line_no"))


def journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a JSON-lines log, and its malformed lines: no JSON, or no type, target or time."""
    rows = lines(spark, path).where(F.trim("value") != "")
    parsed = rows.select("line_no", "value", F.from_json("value", JOURNAL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("line_no", "value", "e.*")
    good = F.col("_bad").isNull() & F.col("type").isNotNull() & F.col("target").isNotNull() & F.col("at").isNotNull()
    return parsed.where(good).drop("_bad", "value"), parsed.where(~good).select("line_no", "value")


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Facts written as JSON lines; lines that are not claims are dropped."""
    return spark.read.schema(CLAIMS).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def git_log(text: DataFrame) -> DataFrame:
    """sha, author, at and path from rows (value, line_no) of `git log --name-only --format=@%H|%an|%aI`. Headers are carried within stretches of lines, and from one to the next."""
    head = F.when(F.col("value").startswith("@"), F.split(F.substring("value", 2, 10_000), r"\|"))
    rows = text.withColumn("_b", F.floor(F.col("line_no") / STRETCH)).withColumn("_own", head)
    ends = rows.groupBy("_b").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("line_no"))).alias("_end"))
    ends = ends.select("_b", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))  # one row a stretch
    carried = F.coalesce(F.last("_own", ignorenulls=True).over(Window.partitionBy("_b").orderBy("line_no")), F.col("_earlier"))
    rows = rows.join(ends, "_b").withColumn("_h", carried).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return rows.select(F.col("_h")[0].alias("sha"), F.col("_h")[1].alias("author"), F.col("_h")[2].alias("at"), F.col("value").alias("path"))


ANSWERS = "qid string, verdict string, subject string, kind string, text string, by string, at string"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers to questions, from JSON lines; lines that are no answer are dropped."""
    return spark.read.schema(ANSWERS).option("mode", "DROPMALFORMED").json(path).where("qid is not null and verdict is not null")


def mined(spark: SparkSession, path: str) -> DataFrame:
    """Candidates for reasons that rank.mined has written, from JSON lines."""
    return spark.read.schema("sha string, subject string, file string, score long").option("mode", "DROPMALFORMED").json(path).where("sha is not null and subject is not null")


def renames(status: DataFrame) -> DataFrame:
    """old and new path from lines of `git diff --name-status`."""
    return status.select(F.regexp_extract("value", r"^R\d*\t([^\t]+)\t([^\t]+)$", 1).alias("old"), F.regexp_extract("value", r"^R\d*\t([^\t]+)\t([^\t]+)$", 2).alias("new")).where("old <> ''")


def write_facts(facts: DataFrame, path: str) -> None:
    """Partitioned by capability, so that a reader of one capability reads no other."""
    facts.repartition("capability").sortWithinPartitions("id").write.mode("overwrite").partitionBy("capability").parquet(path)
