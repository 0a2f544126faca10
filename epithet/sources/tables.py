"""Stage tables and export files.

A table is a folder of snapshots.  A snapshot is written whole under a name of its own; then an empty
file of that name under ``_snapshots`` makes it the current one.  Creating a file is atomic, so a reader
sees the old table or the new one, and a write that fails leaves the old table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from epithet import params

POINTERS = "_snapshots"


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(path))


def snapshots(spark: SparkSession, root: str, name: str) -> list[str]:
    """Names of the snapshots that are or were current, oldest first."""
    return names(spark, f"{table_path(root, name)}/{POINTERS}")


def new_snapshot(spark: SparkSession, root: str, name: str) -> str:
    """A name after all others, for files that no reader sees yet."""
    last = snapshots(spark, root, name)
    number = int(last[-1].split("-")[0]) + 1 if last else 0
    return f"{number:012d}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, name: str, snapshot: str) -> None:
    """Make a written snapshot the current one."""
    path, files = _files(spark, f"{table_path(root, name)}/{POINTERS}/{snapshot}")
    files.create(path, False).close()


def current(spark: SparkSession, root: str, name: str) -> str | None:
    """Folder of the current snapshot, or null where there is none."""
    found = snapshots(spark, root, name)
    return f"{table_path(root, name)}/{found[-1]}" if found else None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current snapshot; a table that has none is a plain folder of files."""
    return spark.read.parquet(current(spark, root, name) or table_path(root, name))


def replace_table(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a stage table in place of the old one, at once for its readers, and return it as read back.

    The next stage starts from files, so it depends on no earlier task.  Older snapshots stay for
    readers that began with them, until ``drop_old``.
    """
    spark = df.sparkSession
    snapshot = new_snapshot(spark, root, name)
    df.write.parquet(f"{table_path(root, name)}/{snapshot}")
    publish(spark, root, name, snapshot)
    return read_table(spark, root, name)


def drop_old(spark: SparkSession, root: str, name: str, keep: int = 1) -> None:
    """Remove all snapshots but the last ``keep``, and what failed writes left behind.

    Call it while nothing writes the table and no reader needs an older snapshot.
    """
    kept = snapshots(spark, root, name)[-keep:]
    for snapshot in names(spark, table_path(root, name)) if kept else []:
        if not snapshot.startswith("_") and snapshot not in kept:
            for folder in (f"{POINTERS}/{snapshot}", snapshot):
                remove(spark, f"{table_path(root, name)}/{folder}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop, files = _files(spark, path)
    files.delete(hadoop, True)


def write_shards(docs: DataFrame, path: str, records: int = params.SHARD_RECORDS) -> None:
    """Gzip JSON lines, at most ``records`` per file."""
    (
        docs.write.mode("overwrite")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records)
        .json(path)
    )


def write_tokens(doc_tokens: DataFrame, path: str) -> None:
    """One ``{"tokens": [...]}`` line per document."""
    doc_tokens.select("tokens").write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for report tables of a bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
