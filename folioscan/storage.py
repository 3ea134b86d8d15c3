"""Tables in the folder that driver and executors share.

They stay there after a session, as checkpoints do by default; the folder's owner expires them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of applications without spark.checkpoint.dir, as in tests.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        name = spark.sparkContext.applicationId
        folder = _OWN[name] = _OWN.get(name) or tempfile.mkdtemp(prefix="spark-shared-")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again; this cuts the lineage, and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, keys: list[str], label: str, then: dict[str, Column] | None = None) -> DataFrame:
    """The rows stored with _p, the number of their range in the order of the keys; equal keys share a range.

    Spark computes the rows twice, first for a sample of the keys; columns in ``then`` are computed once, where the ranges are.
    """
    return stored(df.repartitionByRange(*keys).withColumns({"_p": F.spark_partition_id()} | (then or {})), label)
