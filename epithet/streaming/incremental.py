"""Incremental extraction with Structured Streaming.

Each micro-batch writes its own partial counts under ``batch_id=N`` and overwrites
them when it is retried, so a restart neither loses nor doubles a count.  Readers add
the partials up.  The streaming checkpoint remembers which files were done.

``compact`` folds the partials of finished batches into a base table.  Its snapshot says up to which
batch it counts, and rows and number become current together, so whatever step a crash comes after, a
batch is counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epithet.operators import counts
from epithet.sources import tables
from epithet.sources.corpus import BROKEN, READING, damaged, parsed_lines
from epithet.sources.tables import table_path

PARTIALS = "modifier_partials"
PROGRESS = "progress"
LOST = "lost_lines"
CUT = "cut_files"
BASE = "modifier_base"


def stream_corpus(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(doc_id, text, source) stream over a growing folder of gzip JSON lines.

    With ``file`` and ``_corrupt_record``, which ``write_batch`` takes for its account of losses.
    """
    return parsed_lines(spark.readStream.options(**READING).option("maxFilesPerTrigger", max_files).text(path))


def stream_documents(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """The same over parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _batch_folder(root: str, table: str, batch_id: int) -> str:
    return f"{table_path(root, table)}/batch_id={batch_id}"


def _write(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_batch_folder(root, table, batch_id))


def write_batch(docs: DataFrame, batch_id: int, root: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """Partial modifier counts and the number of documents of one batch, in one pass.

    Broken lines are counted in that pass; they and the files that are cut go to side tables.
    """
    spark, checked = docs.sparkSession, BROKEN in docs.columns
    seen = Observation(f"documents-{batch_id}")
    broken = F.col(BROKEN) if checked else F.lit(None).cast("string")
    asked = (F.count_if(broken.isNull()).alias("docs_seen"), F.count(broken).alias("lines_lost"))
    counted = docs.observe(seen, *asked)
    whole = counted.where(broken.isNull()).drop(BROKEN, "file") if checked else counted
    _write(counts.modifier_rows(extract(whole)), root, PARTIALS, batch_id)
    if checked:
        _write(docs.where(broken.isNotNull()).select("file", broken.alias("line")), root, LOST, batch_id)
        # Files of which some line was read; ``corpus.cut_files`` finds those of which none was, too.
        _write(damaged(docs.select("file").distinct()), root, CUT, batch_id)
    try:
        found = seen.get
    except Py4JJavaError:
        # Nothing came of the batch: adaptive execution put an empty plan in place of the observed one.
        found = docs.agg(*asked).first().asDict()
    done = [F.lit(found[c]).cast("bigint").alias(c) for c in ("docs_seen", "lines_lost")]
    _write(spark.range(1).select(*done), root, PROGRESS, batch_id)


def run_incremental(
    docs: DataFrame, root: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Process every file that has arrived since the last run, then stop.

    ``extract`` maps documents to modifiers, e.g. ``jobs.modifiers_of``.
    """
    return (
        docs.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, batch_id, root, extract))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _base(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """Rows of the current base and the last batch it counts."""
    folder = tables.current(spark, root, BASE)
    if folder is None:
        return None, -1
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/upto").first()[0]


def _batches(spark: SparkSession, root: str, table: str) -> list[int]:
    named = (n for n in tables.names(spark, table_path(root, table)) if n.startswith("batch_id="))
    return sorted(int(n.split("=")[1]) for n in named)


def _partials_after(spark: SparkSession, root: str, batch_id: int) -> dict[int, str]:
    """Folders of the batches after ``batch_id``."""
    return {i: _batch_folder(root, PARTIALS, i) for i in _batches(spark, root, PARTIALS) if i > batch_id}


def _totals(spark: SparkSession, base: DataFrame | None, partials: dict[int, str]) -> DataFrame:
    if not partials:
        return base
    rows = counts.merge_modifier_rows(spark.read.parquet(*partials.values()))
    return rows if base is None else counts.merge_modifier_rows(base, rows)


def modifier_totals(spark: SparkSession, root: str) -> DataFrame:
    """Modifier rows over all batches so far: the base, and the partials after it."""
    base, upto = _base(spark, root)
    return _totals(spark, base, _partials_after(spark, root, upto))


def compact(spark: SparkSession, root: str) -> int:
    """Fold the finished batches into the base and remove their partials; returns the last one counted.

    Call it between runs.  A batch is finished when its progress is written.  Partials that the base
    counts already (a crash came before they were removed) are ignored by readers and removed here.
    """
    base, upto = _base(spark, root)
    finished = set(_batches(spark, root, PROGRESS))
    partials = {i: f for i, f in _partials_after(spark, root, upto).items() if i in finished}
    if partials:
        snapshot = tables.new_snapshot(spark, root, BASE)
        folder = f"{table_path(root, BASE)}/{snapshot}"
        upto = max(partials)
        _totals(spark, base, partials).write.parquet(f"{folder}/rows")
        spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).write.parquet(f"{folder}/upto")
        tables.publish(spark, root, BASE, snapshot)
    for i, folder in _partials_after(spark, root, -1).items():
        if i <= upto:
            tables.remove(spark, folder)
    tables.drop_old(spark, root, BASE)
    return upto


def progress(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, docs_seen, lines_lost)."""
    return spark.read.parquet(table_path(root, PROGRESS)).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "docs_seen", "lines_lost"
    )
