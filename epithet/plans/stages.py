"""Stage boundaries: intermediate tables written to shared storage.

A table read by several later steps is written once, so the corpus is scanned once, a
lost executor costs no recomputation of earlier stages, and the next plan knows the
table's real size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must reach.

    Where it is unset, a session whose executors are threads of this process sets its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="epithet-stages-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read back."""
    path = f"{shared_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
