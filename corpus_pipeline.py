"""From documents to a token stream: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a table that the next one reads; all but the last give the columns of documents. Other columns of docs are left out, so
none can clash. Null texts count as empty in every stage; null ids, languages and sources are values like others; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import fertility, merge_encoding, mixing, near_copies, secret_ledger, tokens
from factweave.llm.common import small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep. Null and empty texts have too few words and go; rows that repeat in full stay as often as they are."""
    return fertility.quality(docs, tokens.public_vocabulary(), COLUMNS).where("kept").select(*COLUMNS)


def named(docs: DataFrame) -> DataFrame:
    """Adds a name of two hashes to each row, so that operators that write tables need not carry texts; rows that repeat in full share it."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_a"), F.xxhash64(F.lit(1), *COLUMNS).alias("_b"))


def rows_of(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """One row for each name in picks(_a, _b, ...), with the columns of docs and of picks. Texts are shuffled once."""
    met = named(docs).join(picks.hint("merge"), ["_a", "_b"])
    return met.dropDuplicates(["_a", "_b"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Of the rows of a class with the smallest doc_id (null only where it has no other) the first by name stays, once if it repeats in full. Null and empty texts are
    a class. Only names of rows to be left out, or that repeat, are joined with the texts.
    """
    rows = written(named(docs).groupBy("_a", "_b").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")))
    found = written(near_copies.classes_of(named(docs)).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    members = rows.join(found, ["_a", "_b"])
    first = written(members.groupBy("class").agg(F.min(order).alias("_r"), F.sum("n").alias("rows")).where("rows > 1").select("class", "_r._a", "_r._b"))
    away = small(written(members.join(first.select("class"), "class", "leftsemi").select("_a", "_b")))
    whole = named(docs).join(away, ["_a", "_b"], "left_anti")
    once = named(docs).join(small(first.select("_a", "_b")), ["_a", "_b"]).dropDuplicates(["_a", "_b"])
    return whole.unionByName(once).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by a mark and n_chars made to fit. A null text stays null; copies of a text are changed alike."""
    out = secret_ledger.ledger_scan(docs, keep=COLUMNS, with_stretches=True)
    out = out.withColumn("text", secret_ledger.redacted(F.col("text"), F.col("stretches")))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat in full as often as all of them together. Null and empty texts have no words and are not taken."""
    taken = mixing.mix(named(docs), ["_a", "_b"]).groupBy("_a", "_b").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    rows = rows_of(docs, written(taken))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token stream: ids of each document, the text decoded from them, and its digests. A null or empty text has no tokens; each row has a result of its own."""
    out = merge_encoding.encode_tokens(docs, tokens.public_vocabulary(), ["doc_id", "lang", "source"])
    return out.select("*", *merge_encoding.digests())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("source mix", weighted_mix),
    ("encoding", encoded),
]

ORACLE_SQL = None


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token stream."""
    return token_stream(spark, sf_dir).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")
