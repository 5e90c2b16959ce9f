"""Where working tables go, and removal of folders of tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="quaystone-", ignore_cleanup_errors=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; only where driver and executor are one process, a folder that ends with it will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = f"file://{_own_folder().name}"
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: working tables need a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a working table, so that what is read several times is computed once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subfolders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern`` (with ``*``), through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [s.getPath().toString() for s in found]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
