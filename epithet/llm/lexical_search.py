"""Ranked lexical search: an automaton of all item terms runs over the documents.

No index of the documents is built.  The terms of the items, each between two boundary marks, form an
Aho-Corasick automaton that is broadcast; one scan of a text, with every byte outside terms replaced by
the mark, gives the frequency of every item term in it.  Weights follow from the scan's totals.  Then
each document's frequencies meet the items through the automaton's outputs, and a task keeps the best
documents of every item.

Items go in blocks of bounded size, so any number of items can be asked for; each block is one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epithet.llm.common import Shared, in_slices, lower_ascii, stage

# Terms are runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

TOP = 10
BLOCK_ITEMS = 4096
BLOCK_CHARS = 1 << 23  # of the distinct terms of a block's items
PIECE = 1 << 20
PAIRS = 1 << 22  # (document, item) contributions summed at once
SALTS = 64

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Terms:
    """The terms of a block of items as a boundary-guarded automaton."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms in a text; item terms in it and how often they occur."""
        total, found = 0, []
        for piece in _pieces(text.translate(_FOLD)):
            codes = np.frombuffer(piece, np.uint8) != 32
            total += int(np.count_nonzero(codes[1:] & ~codes[:-1]))
            hits = self.automaton.iter(piece.decode("latin-1"))
            found.append(np.fromiter(map(itemgetter(1), hits), np.int32))
        terms, counts = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
        return total, np.asarray(terms, np.int32), np.asarray(counts, np.int64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts that end at a boundary, with a mark on either side."""
    start = 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        if end < len(text):
            end = at if (at := text.find(b" ", end)) >= 0 else len(text)
        yield b" " + text[start:end] + b" "
        start = end


class Scorer:
    """Weights of a block's terms and the items that each term belongs to."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, docs: int, total: int):
        self.n_items, self.weights, self.docs, self.total = len(items), weights, docs, total
        pairs = np.array(list(chain.from_iterable(((t, i) for t in ts) for i, ts in enumerate(items))), np.int64)
        pairs = pairs.reshape(-1, 2)[np.argsort(pairs.reshape(-1, 2)[:, 0], kind="stable")]
        self.items = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))

    def fan_out(self, terms: np.ndarray) -> np.ndarray:
        """How many items each term belongs to."""
        return self.starts[terms + 1] - self.starts[terms]

    def scores(self, n: list[int], rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(document, item) scores from (row, term, count) triples, in whole numbers."""
        m = np.array([10 + 90 * x * self.docs // self.total for x in n], np.int64)
        gain = self.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[rows]))
        fan = self.fan_out(terms)
        within = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        item = self.items[np.repeat(self.starts[terms], fan) + within]
        out = np.zeros(len(n) * self.n_items, np.int64)
        np.add.at(out, np.repeat(rows, fan) * self.n_items + item, np.repeat(gain, fan))
        return out.reshape(len(n), self.n_items)


class _Best:
    """The best documents of every item so far: two arrays of TOP rows."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.scores = np.zeros((0, n_items), np.int64)
        self.ids = np.zeros((0, n_items), np.int64)
        self.unknown = np.zeros((0, n_items), bool)  # rows without an id come last among equals

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        order = np.lexsort((ids, unknown))
        scores, ids, unknown = scores[order], ids[order], unknown[order]
        if len(scores) > self.top:
            # Equal scores fall by place, so the key has no ties.
            key = scores * len(scores) + np.arange(len(scores))[::-1, None]
            at = np.argpartition(key, -self.top, axis=0)[-self.top :]
        else:
            at = np.broadcast_to(np.arange(len(scores))[:, None], scores.shape)
        all_scores = np.concatenate([self.scores, np.take_along_axis(scores, at, 0)])
        all_ids = np.concatenate([self.ids, ids[at]])
        all_unknown = np.concatenate([self.unknown, unknown[at]])
        order = np.lexsort((all_ids, all_unknown, -all_scores), axis=0)[: self.top]
        self.scores = np.take_along_axis(all_scores, order, 0)
        self.ids = np.take_along_axis(all_ids, order, 0)
        self.unknown = np.take_along_axis(all_unknown, order, 0)


def term_column(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _blocks(pairs: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of items with their distinct terms; ``pairs`` has item_id and term, without repeats.

    Items are dealt by hash; a block above the bounds is cut in two until it is within them or has
    one item alone.
    """
    sizes = pairs.groupBy("item_id").agg(F.sum(F.length("term")).alias("chars"))
    queue = [(0, 1)]
    while queue:
        rest, of = queue.pop()
        mine = F.pmod(F.xxhash64("item_id"), F.lit(of)) == rest
        n, chars = sizes.where(mine).agg(F.count("*"), F.sum("chars")).first()
        if n > 1 and of < 1 << 40 and (n > BLOCK_ITEMS or chars > BLOCK_CHARS):
            queue += [(rest, 2 * of), (rest + of, 2 * of)]
        elif n:
            held = pairs.where(mine).select("item_id", "term").toArrow()
            found: dict = {}
            for item, term in zip(held["item_id"].to_pylist(), held["term"].to_pylist(), strict=True):
                found.setdefault(item, []).append(term)
            yield list(found.items())


def _scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has a term at all."""
    shared = Shared(docs.sparkSession, Terms(terms))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shared.value.scan((t.as_py() or "").encode()) for t in batch["text"]]
            kept = [i for i, f in enumerate(found) if f[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(kept, pa.int64())),
                    pa.array([found[i][0] for i in kept], pa.int64()),
                    pa.array([found[i][1] for i in kept], pa.list_(pa.int32())),
                    pa.array([found[i][2] for i in kept], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(scan, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def _task_best(scanned: DataFrame, scorer: Scorer, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every item in each task."""
    shared = Shared(scanned.sparkSession, scorer)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        best = _Best(scorer.n_items, top)
        for batch in in_slices(batches, max(1, min(512, (1 << 21) // scorer.n_items))):
            terms, counts = batch["terms"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
            sizes = np.array([len(t) for t in batch["terms"]])
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            n = batch["n"].to_pylist()
            unknown = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(0).to_numpy()
            # Runs of documents whose contributions fit in memory.
            load = np.cumsum(np.bincount(rows, scorer.fan_out(terms), len(n)))
            begin = 0
            while begin < len(n):
                before = load[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(load, before + PAIRS, "right")))
                at = slice(*np.searchsorted(rows, [begin, end]))
                scores = scorer.scores(n[begin:end], rows[at] - begin, terms[at], counts[at])
                best.add(scores, ids[begin:end], unknown[begin:end])
                begin = end
        place, item = np.nonzero(best.scores > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item.astype(np.int32)),
                pa.array(best.ids[place, item], mask=best.unknown[place, item]),
                pa.array(best.scores[place, item]),
            ],
            ["item", "doc_id", "score"],
        )

    rows = scanned.where(F.size("terms") > 0)
    return rows.mapInArrow(rank, "item int, doc_id bigint, score bigint")


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The best of all tasks: first within a salt of an item, then of the item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))
    few = salted.withColumn("rank", first).where(F.col("rank") <= top).drop("rank", "salt")
    whole = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return few.withColumn("rank", whole).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, scores above 0.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text; other columns are ignored.
    A null text has no terms, like an empty one; a document without terms counts nowhere and an item
    without terms has no rows.  Rows of the same item_id are one item with the terms of all.  Each row
    of ``docs`` is a document, so one that stands twice is ranked twice; equal scores go by doc_id,
    nulls last.  Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = items.select("item_id", F.explode(term_column(F.col("text"))).alias("term")).distinct()
    pairs = stage(pairs, "search-items")
    parts = []
    for block in _blocks(pairs):
        terms = sorted({t for _, ts in block for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        scanned = stage(_scan(docs, terms), "search-scan")
        n_docs, total = scanned.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
        held = scanned.select(F.explode("terms").alias("term")).groupBy("term").count()
        # One row for each term of the block.
        frequency = {row["term"]: row["count"] for row in held.collect()}
        weights = [
            math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(terms))
        ]
        scorer = Scorer([[number[t] for t in ts] for _, ts in block], np.array(weights, np.int64), n_docs, total)
        ranked = _ranked(_task_best(scanned, scorer, top), top)
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(len(block)), pa.int32()), "item_id": pa.array([i for i, _ in block])})
        ).withColumn("item_id", F.col("item_id").cast(kind))
        parts.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
