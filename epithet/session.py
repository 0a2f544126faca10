"""Session with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "epithet", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one.  Cluster settings are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have thousands of expressions; recording a call site for each takes half the time of
        # building them.  Switch it on to have them in error messages.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
