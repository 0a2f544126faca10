"""Token counts of documents in flat token files that have no index.

A flat file is a run of fixed-width token ids in which a reserved id ends each document.  Files of any
size are read in byte ranges, each with a seek of its own; a vectorised comparison finds the separators
of a block, and a prefix scan over one short row per block stitches the documents that cross block
borders.  What comes out are documents by file and ordinal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epithet.llm.common import in_slices, shared_root, stage, word_hashes

BLOCK_BYTES = 1 << 20
# Hashed word ids of the registered query: 0 to 65,534 are words, the last number ends a document.
WORD_IDS, END_OF_DOCUMENT, DTYPE = 65_535, 65_535, "<u2"


def flat_blocks(files: DataFrame, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, tokens) of the flat files in ``files`` (file: a URI, length in bytes).

    A row for each range of a file is dealt to the tasks, which read it from there; ranges are whole
    tokens, and a last token that is cut is left out.
    """
    width = np.dtype(dtype).itemsize
    size = max(width, block_bytes // width * width)
    whole = F.col("length") - F.col("length") % width
    starts = F.filter(F.sequence(F.lit(0).cast("long"), whole, F.lit(size).cast("long")), lambda at: at < whole)
    ranges = files.select("file", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.lit(size).cast("long"), whole - F.col("start")).alias("size"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, n in zip(*(batch[c].to_pylist() for c in ("file", "start", "size")), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as opened:
                    tokens = opened.read_at(n, start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([start // size], pa.int64()), pa.array([tokens], pa.binary())],
                    ["file", "block", "tokens"],
                )

    n = ranges.sparkSession.sparkContext.defaultParallelism
    spread = ranges.repartition(max(n, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file", "start")
    return spread.mapInArrow(read, "file string, block bigint, tokens binary")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files in a folder or glob, as Spark lists them; none is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "length")


def write_flat(docs: DataFrame, folder: str) -> DataFrame:
    """Write the word ids of the documents as flat files in ``folder``.

    Gives rows of two kinds: (file, ordinal, doc_id) for each document, and (file, length) for each file.
    The files hold ids and separators alone.  A task names its files itself, so what a lost task wrote
    is in no row.  A null text has no tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, out, length, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", None, 0, 0
        for batch in in_slices(batches, 256):
            if out is None:
                out = store.open_output_stream(f"{top}/{name.rsplit('/', 1)[1]}", compression=None)
            for text in batch["text"]:
                ids = (word_hashes((text.as_py() or "").encode()) % np.uint64(WORD_IDS)).astype(DTYPE)
                data = np.append(ids, np.array([END_OF_DOCUMENT], DTYPE)).tobytes()
                out.write(data)
                length += len(data)
            n = batch.num_rows
            ids = batch["doc_id"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), ids, pa.nulls(n, pa.int64())],
                ["file", "ordinal", "doc_id", "length"],
            )
            ordinal += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, ids.type), pa.array([length], pa.int64())],
                ["file", "ordinal", "doc_id", "length"],
            )

    return docs.select("doc_id", "text").mapInArrow(write, f"file string, ordinal bigint, doc_id {kind}, length bigint")


def _scan(blocks: DataFrame, separator: int, dtype: str) -> DataFrame:
    """Per block: its length, the number of separators, tokens before the first, between, after the last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content in batch["tokens"]:
                tokens = np.frombuffer(content.as_buffer() or b"", dtype)
                at = np.flatnonzero(tokens == separator)
                tail = len(tokens) - (int(at[-1]) + 1) if len(at) else len(tokens)
                counts = np.diff(np.concatenate(([-1], at))) - 1
                out.append((len(tokens), len(at), counts.astype(np.int64), tail))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "tokens"]
            names = [n for n in batch.schema.names if n != "tokens"]
            made = [
                pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.list_(pa.int64())),
                pa.array([o[3] for o in out], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(kept + made, [*names, "length", "n_ends", "counts", "tail"])

    others = [f for f in blocks.schema.fields if f.name != "tokens"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return blocks.mapInArrow(scan, f"{schema}, length bigint, n_ends bigint, counts array<bigint>, tail bigint")


def count_tokens(
    blocks: DataFrame, separator: int = END_OF_DOCUMENT, dtype: str = DTYPE
) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document, the separator not counted.

    ``blocks`` has file, block (in order within a file) and tokens.  A document may span any number of
    blocks.
    What follows a file's last separator is a document with ``ended`` false, if it has tokens.
    Empty documents count 0; an empty or null block adds nothing.
    """
    scanned = _scan(blocks.select("file", "block", "tokens"), separator, dtype)
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    has_end = F.col("n_ends") > 0
    zero = F.lit(0).cast("long")
    placed = (
        scanned.withColumn("first", F.coalesce(F.sum("n_ends").over(past), zero))
        .withColumn("segment", F.coalesce(F.sum(has_end.cast("long")).over(past), zero))
        .withColumn("open", F.coalesce(F.last(F.when(has_end, F.col("tail")), True).over(past), zero))
        .withColumn("last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1)
    )
    within = Window.partitionBy("file", "segment").orderBy("block")
    stitched = placed.withColumn(
        "carry",
        F.col("open") + F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), zero),
    )
    ended = F.transform(
        "counts",
        lambda n, i: F.struct(
            (F.col("first") + i).alias("ordinal"),
            (n + F.when(i == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
            F.lit(True).alias("ended"),
        ),
    )
    rest = F.when(has_end, F.col("tail")).otherwise(F.col("carry") + F.col("length"))
    unended = F.when(
        F.col("last") & (rest > 0),
        F.array(
            F.struct(
                (F.col("first") + F.col("n_ends")).alias("ordinal"),
                rest.alias("n_tokens"),
                F.lit(False).alias("ended"),
            )
        ),
    )
    documents = F.explode(F.concat(ended, F.coalesce(unended, F.slice(ended, 1, 0))))
    return stitched.select("file", documents.alias("d")).select("file", "d.*")


def document_token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): documents as flat files of word ids, written, read in ranges and stitched.

    The files know no documents: a count gets its id by file and ordinal.  A null or empty text has no
    tokens, repeated rows are counted each, and ids may be of any type, null too.  Other columns are
    ignored; an empty table gives no rows.
    """
    folder = f"{shared_root(docs.sparkSession)}/llm-tokens-{uuid.uuid4().hex}"
    written = stage(write_flat(docs, folder), "token-names")
    counted = count_tokens(flat_blocks(written.where("length is not null").select("file", "length")))
    # Packed as they are in their files, names look small enough to broadcast; they grow with the corpus.
    names = written.where("length is null").select("file", "ordinal", "doc_id").hint("merge")
    return counted.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens")
