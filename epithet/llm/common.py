"""What several of these operators share: stage tables, the word pattern, stable hashes."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of this process sets a temporary
    folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="epithet-llm-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Shared:
    """An object of bounded size that every task reads; workers keep it from task to task.

    It travels by value, so the executors need not have this package installed.
    """

    def __init__(self, spark: SparkSession, value: object):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self._data, "loaded"):
            self._data.loaded = pickle.loads(self._data.value)
        return self._data.loaded


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array of one element."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Words of a text that is not null, in order."""
    return F.filter(F.split(col, SPACE), lambda w: w != "")


def remainder5(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % 5


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


# --- hashes inside Arrow batches -------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_VALUES = _byte_values()
_POWERS = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        _POWERS.update(n=size, up=_powers(_BASE, size), down=_powers(pow(_BASE, -1, 1 << 64), size))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z taken as a-z, in order.

    A polynomial over prefix sums hashes all words of a piece at once.  Long texts go in pieces
    that end at white space, so memory stays near the piece size (or the longest word).
    """
    if len(text) > _PIECE:
        out, start = [], 0
        while start < len(text):
            end = min(start + _PIECE, len(text))
            while end < len(text) and not _SPACES[text[end]]:
                end += 1
            out.append(_piece_hashes(text[start:end]))
            start = end
        return np.concatenate(out)
    return _piece_hashes(text)


def _piece_hashes(text: bytes) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text, np.uint8)
    edge = np.zeros(len(codes) + 2, np.int8)
    edge[1:-1] = ~_SPACES[codes]
    edge = np.diff(edge)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUES[codes] * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words count as one run."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + hashes[i : i + n]
    return np.unique(mix(total))
