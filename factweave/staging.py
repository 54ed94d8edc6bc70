"""Staged tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # at three longs a row some 40 MB in memory

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset it is a temporary folder of this process, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="factweave-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/factweave-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table and read it back: cuts the lineage, survives lost executors and lets later joins split hot keys."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(names: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, to be sent to all executors if its rows are counted to be at most `most`; else joined by a shuffle."""
    return F.broadcast(names) if names.count() <= most else names.hint("merge")
