"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair prefers a document marked good to one marked bad.  The log-odds of a preference are the
difference of two scores that are linear in the features, so the weights come from logistic loss on
feature differences.  A quantile of the training scores, at the share of bad documents, becomes the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epithet.llm.common import Shared, remainder5, stage, word_hashes

# Documented bound of the labelled rows that the fit uses; everything else covers all rows.
MAX_LABELLED = 20_000
PAIRS_PER_ROW = 4
THRESHOLD = 0.3
FEATURES = (
    "log_words", "upper_share", "symbols_per_word", "bangs_per_word", "bars_per_word", "digit_share",
    "word_length", "stops_per_word", "commas_per_word", "distinct_share", "echo_share",
    "repeated_triples", "repeated_lines", "letter_share",
)


def features(text: str) -> np.ndarray:
    """Measures of one whole text, null and empty texts as all zeros."""
    raw = text.encode()
    hashes = word_hashes(raw)
    n = len(hashes)
    if not n:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: int(counts[list(chars)].sum())
    upper = of(range(65, 91))
    letters = upper + of(range(97, 123)) + of(range(192, 256))
    triples = hashes[: n - 2] * np.uint64(3) ^ hashes[1 : n - 1] * np.uint64(5) ^ hashes[2:] if n > 2 else hashes[:0]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return np.array(
        [
            np.log1p(n) / 10,
            upper / max(1, letters),
            np.sqrt(of(b"#*$%&<>") / n),
            np.sqrt(of(b"!") / n),
            np.sqrt(of(b"|") / n),
            np.sqrt(of(b"0123456789") / len(raw)),
            min(len(raw) / n, 40) / 10,
            np.sqrt(of(b".?") / n),
            np.sqrt(of(b",") / n),
            len(np.unique(hashes)) / n,
            np.sqrt((hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0),
            np.sqrt(1 - len(np.unique(triples)) / max(1, len(triples)) if n > 2 else 0.0),
            np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
            letters / len(raw),
        ]
    )


@dataclass(frozen=True)
class Ranker:
    """``weights`` act on the features; ``cut`` is the raw score that THRESHOLD stands for."""

    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        base = np.log(THRESHOLD / (1 - THRESHOLD)) if self.weights.any() else 0.0
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.cut + base, -500, 500)))


def preference_pairs(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Feature differences: every row is in ``PAIRS_PER_ROW`` pairs or more, linear in the rows."""
    n = max(len(good), len(bad)) * PAIRS_PER_ROW
    if not len(good) or not len(bad):
        return np.zeros((0, len(FEATURES)))
    i = np.arange(n)
    return good[i % len(good)] - bad[(i + i // len(good)) % len(bad)]


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Newton steps on the mean logistic loss of the pairs; without pairs every score is 0.5."""
    pairs = preference_pairs(x[good], x[~good])
    weights = np.zeros(len(FEATURES))
    if not len(pairs):
        return Ranker(weights, 0.0)
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(pairs @ weights, -500, 500)))
        slope = ridge * weights - (pairs * lost[:, None]).mean(axis=0)
        bend = (pairs * (lost * (1 - lost))[:, None]).T @ pairs / len(pairs) + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 10 / max(1e-12, np.abs(step).max()))
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    raw = np.sort(x @ weights)
    at = int((~good).sum())  # the quantile at the share of bad rows, midway to the next score
    return Ranker(weights, float((raw[at - 1] + raw[at]) / 2))


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on at most ``MAX_LABELLED`` labelled documents, chosen by a hash of their id.

    Rows whose crc32(doc_id as text) mod 5 is 0, and labels other than 0 and 1, are left out.
    """
    usable = labels.where((remainder5() != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELLED)
    # Broadcast: the limit above bounds it.
    texts = docs.select("doc_id", "text").join(F.broadcast(stage(chosen, "labelled")), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"], batch["tie"], pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "quality", "tie", "x"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, tie bigint, x array<double>"
    measured = texts.select("doc_id", "quality", F.xxhash64("text").alias("tie"), "text").mapInArrow(measure, schema)
    # An id may stand on any number of rows: the one with the smallest hash of its text speaks for it.
    single = measured.groupBy("doc_id", "quality").agg(F.min_by("x", "tie").alias("x"))
    rows = single.toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["quality"] == 1 for r in rows], bool))


def with_scores(docs: DataFrame, ranker: Ranker, name: str = "score") -> DataFrame:
    """``docs`` and their scores (0 to 1) in a new column, which must not be among theirs."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = Shared(docs.sparkSession, ranker)
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(FEATURES))
            scores = pa.array(shared.value.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    A null or empty text has all features zero and a score like any other.  With no labelled pair
    every score is 0.5.  Repeated rows get equal scores; an empty table gives no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder5() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """Documents at or above the threshold; columns as in ``docs``, whatever their names."""
    scored = with_scores(docs, ranker, "__quality_score")
    return scored.where(F.col("__quality_score") >= THRESHOLD).drop("__quality_score")
