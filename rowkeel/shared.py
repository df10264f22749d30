"""The folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, for a local master only, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rowkeel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut, and a lost executor loses nothing. The caller or the folder's cleaning deletes it."""
    path = f"{shared_dir(df.sparkSession)}/rowkeel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
