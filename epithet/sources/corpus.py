"""Readers: text corpora, lexicon tables, the census label file, count tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from epithet.functions.arrays import unnest
from epithet.operators.lexicon_table import LexiconTable

CORPUS_SCHEMA = "id string, text string, source string"
CORPUS_FILES = "*.json*.gz"
# A line that is no JSON object is kept whole in this column.
BROKEN = "_corrupt_record"
PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
# A cut file gives the lines before the cut; ``cut_files`` names it.
READING = {"ignoreCorruptFiles": "true", "pathGlobFilter": CORPUS_FILES}

CENSUS_COLUMNS = (
    "geo_id", "name", "total", "popgroup", "label", "family", "married_couple",
    "other_family", "male_householder", "female_householder", "nonfamily",
    "living_alone", "not_alone",
)
_CENSUS_COUNTS = tuple(c for c in CENSUS_COLUMNS if c not in ("geo_id", "name", "popgroup", "label"))


@dataclass(frozen=True)
class Scan:
    """What a corpus scan gives: the documents, and an account of what is not in them.

    ``counts`` is filled by the first action that reads ``docs`` to its end: ``counts.get`` has
    ``lines`` (all that were read) and ``broken``.  ``broken`` (file, line) lists the broken lines and
    ``cut()`` (file, lines, error) the files that end too early or are no gzip; each is a pass of its
    own, made only when it is used.
    """

    docs: DataFrame
    counts: Observation
    broken: DataFrame
    path: str

    def cut(self) -> DataFrame:
        return cut_files(self.docs.sparkSession, self.path)


def scan_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> Scan:
    """(doc_id, text, source) from gzip JSON lines, and what could not be read.

    Unknown keys are left out.  Gzip files cannot be split: give ``partitions`` when there are fewer
    files than tasks should run; the rows are then dealt in turn before any text work.
    """
    lines = parsed_lines(spark.read.options(**READING).text(path))
    counts = Observation()
    seen = lines.observe(counts, F.count(F.lit(1)).alias("lines"), F.count(BROKEN).alias("broken"))
    docs = seen.where(F.col(BROKEN).isNull()).select("doc_id", "text", "source")
    broken = lines.where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("line"))
    return Scan(docs.repartition(partitions) if partitions else docs, counts, broken, path)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(file, doc_id, text, source, _corrupt_record) of lines that are not blank; each is parsed once."""
    record = F.from_json("value", f"{CORPUS_SCHEMA}, {BROKEN} string", PARSING)
    rows = lines.where(F.col("value").rlike(r"\S")).select(
        F.col("_metadata.file_path").alias("file"), unnest(F.array(record)).alias("r")
    )
    return rows.select("file", F.col("r.id").alias("doc_id"), "r.text", "r.source", f"r.{BROKEN}")


def read_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The documents of ``scan_corpus`` alone, for callers that need no account."""
    return scan_corpus(spark, path, partitions).docs


def cut_files(spark: SparkSession, path: str, glob: str = CORPUS_FILES) -> DataFrame:
    """(file, lines, error) of the gzip files that cannot be read to their end.

    ``lines`` counts the whole lines before the damage.  Files are listed by Spark and inflated as
    streams, one piece at a time; nothing of them is kept.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return damaged(listed.select(F.col("_metadata.file_path").alias("file")))


def damaged(files: DataFrame) -> DataFrame:
    """(file, lines, error) of the URIs in ``file`` whose gzip stream is cut or wrong."""

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch["file"].to_pylist():
                lines, error = _inflated(file)
                if error:
                    rows.append({"file": file, "lines": lines, "error": error})
            yield pa.RecordBatch.from_pylist(rows, _DAMAGE)

    n = files.count()
    return files.select("file").repartitionByRange(max(n, 1), "file").mapInArrow(
        inflate, "file string, lines bigint, error string"
    )


_DAMAGE = pa.schema([("file", pa.string()), ("lines", pa.int64()), ("error", pa.string())])


def _inflated(file: str) -> tuple[int, str | None]:
    """Whole lines of a gzip file, and what is wrong with it."""
    store, name = fs.FileSystem.from_uri(file)
    lines, held, unpack = 0, b"", None
    with store.open_input_stream(name, compression=None) as stream:
        while True:
            data = held or stream.read(1 << 18)
            held = b""
            if not data:
                return lines, None if unpack is None else "ends within a member"
            unpack = unpack or zlib.decompressobj(31)
            try:
                lines += unpack.decompress(data).count(b"\n")
            except zlib.error as error:
                return lines, str(error)
            if unpack.eof:
                held, unpack = unpack.unused_data.lstrip(b"\0"), None


def read_corpora(
    spark: SparkSession, paths: Sequence[str], glob: str = "*.jsonl.gz", schema: str | None = None
) -> DataFrame:
    """Several folders as one table: columns united by name.

    Give a ``schema`` for large folders; without one, Spark reads all data to infer it.  Lines that are
    no JSON stand in ``_corrupt_record`` (add it to a schema of your own); a file that is cut gives
    the lines before the cut, and ``cut_files`` names it.
    """
    reader = spark.read.options(**{**READING, **PARSING, "pathGlobFilter": glob})
    frames = [(reader.schema(schema) if schema else reader).json(p) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def documents(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Projection every text operator starts from; optional columns may be absent.

    Give ``partitions`` for an input that Spark cannot split into as many tasks as should run (one file
    of one row group, gzip): its rows are dealt in turn, whatever their keys.  Without it the splits of
    the files decide, and no text is moved.
    """
    wanted = [c for c in ("doc_id", "text", "source") if c in df.columns]
    docs = df.select(*wanted)
    return docs.repartition(partitions) if partitions else docs


def read_lexicon(spark: SparkSession, path: str, column: str = "term") -> LexiconTable:
    """Lexicon from a parquet table or a CSV file with a header, of any size."""
    table = (
        spark.read.option("header", "true").csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    )
    return LexiconTable.of(table, column)


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """Population table: two header rows, quoted numbers, a trailing comma."""
    fields = ", ".join(f"{c} string" for c in (*CENSUS_COLUMNS, "trailing"))
    raw = spark.read.schema(fields).option("header", "true").option("enforceSchema", "true").csv(path)
    counts = [F.col(c).cast("bigint").alias(c) if c in _CENSUS_COUNTS else F.col(c) for c in CENSUS_COLUMNS]
    return raw.where(F.col("geo_id") != "Geography").select(*counts)


def census_terms(census: DataFrame) -> DataFrame:
    """Group names from population labels: qualifier cut, lists split, ``Other …`` dropped."""
    bare = F.regexp_replace("label", r"\s+alone.*$", "")
    names = census.select(F.explode(F.split(bare, r",\s*")).alias("name"))
    named = names.where(~F.col("name").rlike("^(Other|except)\\b"))
    return named.select(F.lower(F.trim("name")).alias("term")).where("term <> ''").distinct()


def census_lexicon(census: DataFrame, taxonomy: DataFrame) -> LexiconTable:
    """Lexicon of the census labels and the taxonomy's terms."""
    return LexiconTable.of(census_terms(census).union(taxonomy.select("term")))
