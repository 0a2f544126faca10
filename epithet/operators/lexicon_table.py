"""Lexicons of any size: a table that the runs of tokens, or substrings, of documents are joined with.

Terms are neither collected nor written into the plan.  A document row tests its own runs against a bit
filter of the lexicon, of a bounded size; what passes, a few runs per sentence, is joined with the
table, and the join decides.  So the work on texts grows with the number of different term lengths and
not with the number of terms; beyond the filter's bound more runs pass, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet.functions import rolling
from epithet.functions import text as T
from epithet.functions.arrays import unnest
from epithet.plans.stages import settle

BITS_PER_TERM = 16
# A text has as many substrings of a length as letters, so fewer may pass: with two bits a term about
# four of a million, up to the number of terms that fills the bound.
BITS_PER_NEEDLE = 1024
MAX_WORDS = 1 << 20  # of 64 bits: what every task holds of a lexicon, 8 MB at most


@dataclass(frozen=True)
class LexiconTable:
    """``frame``: surface, grp, n_words, exact (false for a plural), one row per surface."""

    frame: DataFrame

    @classmethod
    def of(cls, terms: DataFrame, column: str = "term", always_plural: bool = False) -> LexiconTable:
        """From a table with one term per row; nulls, blanks and repeats are dropped.

        Terms are lower-cased, their words joined by ``_``.  A plural is added as in ``Lexicon``; an
        exact term wins over a plural.
        """
        named = T.normalize_form(T.strip(F.col(column)))
        exact = terms.select(named.alias("grp")).where("grp <> ''").distinct()
        plural = F.when(F.lit(always_plural) | ~F.col("grp").endswith("s"), F.concat("grp", F.lit("s")))
        forms = F.array(
            F.struct(F.col("grp").alias("surface"), F.lit(True).alias("exact")),
            F.struct(plural.alias("surface"), F.lit(False).alias("exact")),
        )
        rows = exact.select("grp", F.explode(forms).alias("f")).select("f.surface", "grp", "f.exact")
        best = rows.where("surface is not null").groupBy("surface").agg(F.max_by("grp", "exact").alias("grp"), F.max("exact").alias("exact"))
        words = F.size(F.split("surface", "_"))
        return cls(settle(best.select("surface", "grp", words.alias("n_words"), "exact")))

    @property
    def terms(self) -> DataFrame:
        return self.frame.where("exact").select(F.col("surface").alias("term"), "n_words")


def _filter_words(n: int, bits: int = BITS_PER_TERM) -> int:
    """Length of the filter in words: a power of two, from the number of terms, up to the bound."""
    wanted = max(1, -(-n * bits // 64))
    return min(MAX_WORDS, 1 << (wanted - 1).bit_length())


def _mark(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))


# ---------------------------------------------------------------------------
# Runs of tokens
# ---------------------------------------------------------------------------


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """Word of the filter that a key falls in, and its two bits there."""
    marks = _mark(key).bitwiseOR(_mark(F.shiftrightunsigned(key, 6)))
    return F.shiftrightunsigned(key, 12).bitwiseAND(F.lit(words - 1).cast("bigint")), marks


def _run_filter(terms: DataFrame, words: int) -> DataFrame:
    """(word, held): the filter, a row for each word that is not empty."""
    word, marks = _place(F.xxhash64("term"), words)
    return terms.select(word.alias("word"), marks.alias("marks")).groupBy("word").agg(F.bit_or("marks").alias("held"))


def _possible_runs(sents: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``sents`` with each run (i, k, run) of their tokens that passes the filter.

    The runs are made and tested where the sentence is read: the filter is broadcast, and its size has a
    bound.
    """
    words = _filter_words(terms.count())
    # A few numbers: the word counts that terms have.
    lengths = sorted({1, *(r[0] for r in terms.select("n_words").distinct().collect())})

    def of_length(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("tokens")), lambda i: i <= F.size("tokens") - k)

        def run(i: Column) -> Column:
            return F.get("tokens", i) if k == 1 else F.array_join(F.slice("tokens", i + 1, k), "_")

        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), run(i).alias("run")))

    runs = sents.select("*", F.explode(F.concat(*map(of_length, lengths))).alias("r"))
    word, marks = _place(F.xxhash64("r.run"), words)
    keyed = runs.withColumns({"word": word, "marks": marks})
    passed = keyed.join(F.broadcast(_run_filter(terms, words)), "word").where(
        F.col("held").bitwiseAND(F.col("marks")) == F.col("marks")
    )
    return passed.select(*sents.columns, "r.*")


def mention_sentences(docs: DataFrame, lexicon: LexiconTable) -> DataFrame:
    """As ``sentences.mention_sentences``: doc_id, sent_id, sentence, tokens (multiword terms merged) and
    overlap.

    Sentences with runs that pass the filter are written; their runs meet the lexicon by key, and the
    hits return to their sentence.  No text is shuffled but that of these sentences.
    """
    terms = lexicon.terms
    split = F.transform(
        T.sentences(F.col("text")),
        lambda s: F.struct(s["sent_id"], s["sentence"], T.words(s["sentence"]).alias("tokens")),
    )
    sents = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.explode(split).alias("s"))
    rows = settle(_possible_runs(sents.select("doc_id", "uid", "s.*"), terms))

    asked = rows.select("uid", "sent_id", "i", "k", "run")
    hits = asked.join(terms, F.col("run") == F.col("term")).where("k = 1 or k = n_words")
    per_row = hits.groupBy("uid", "sent_id").agg(
        F.sort_array(F.collect_list(F.struct("i", (-F.col("k")).alias("back"), "run"))).alias("hits")
    )
    texts = rows.groupBy("uid", "sent_id").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "sentence", "tokens")]
    )
    spans = F.transform(
        F.filter("hits", lambda h: h["back"] < -1), lambda h: F.struct(h["i"].alias("i"), (-h["back"]).alias("k"))
    )
    chosen = texts.join(per_row, ["uid", "sent_id"]).withColumn("taken", T.leftmost_spans(spans))
    free = F.filter(
        "hits",
        lambda h: F.when(
            h["back"] == -1, ~F.exists("taken", lambda t: (h["i"] >= t["i"]) & (h["i"] < t["i"] + t["k"]))
        ).otherwise(F.exists("taken", lambda t: (h["i"] == t["i"]) & (-h["back"] == t["k"]))),
    )
    return chosen.select(
        "doc_id",
        "sent_id",
        "sentence",
        T.merge_spans(F.col("tokens"), F.col("taken")).alias("tokens"),
        F.array_distinct(F.transform(free, lambda h: h["run"])).alias("overlap"),
    )


# ---------------------------------------------------------------------------
# Substrings
# ---------------------------------------------------------------------------


def _substring_filter(needles: DataFrame) -> np.ndarray:
    """Bits of the needles' hashes; only the filter, of a bounded size, reaches the driver."""
    words = _filter_words(needles.count(), BITS_PER_NEEDLE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [b for n in batch["needle"] for b in rolling.bits(rolling.whole_hash(n.as_py().encode()), words * 64)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    bits = needles.mapInArrow(hashed, "bit bigint")
    marks = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_mark(F.col("bit"))).alias("marks")).toArrow()
    known = np.zeros(words, np.uint64)
    known[marks["word"].to_numpy()] = marks["marks"].to_numpy().view(np.uint64)
    return known


def _with_substrings(df: DataFrame, folded: str, needles: DataFrame) -> DataFrame:
    """Adds ``found``: array<struct<part, runs>> of the substrings of ``folded`` that pass the filter.

    ``part`` counts the NUL characters before its substrings.  Each length of a needle costs one pass over
    the numbers of a text.
    """
    lengths = sorted(r[0] for r in needles.select(F.octet_length("needle")).distinct().collect())
    known = df.sparkSession.sparkContext.broadcast(_substring_filter(needles))
    kind = pa.list_(pa.struct([("part", pa.int32()), ("runs", pa.list_(pa.string()))]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch, found = whole.slice(start, 64), []
                for text in batch[folded]:
                    data = (text.as_py() or "").encode()
                    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
                    hits = {
                        (int(np.searchsorted(ends, at)), data[at : at + n])
                        for at, n in rolling.find(data, lengths, known.value, twice=True)
                    }
                    rows: dict[int, list[str]] = {}
                    for part, run in sorted(hits):
                        try:
                            rows.setdefault(part, []).append(run.decode())
                        except UnicodeDecodeError:  # cut within a character: no needle
                            continue
                    found.append([{"part": part, "runs": runs} for part, runs in rows.items()])
                yield batch.append_column("found", pa.array(found, kind))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(search, f"{schema}, found array<struct<part:int,runs:array<string>>>")


def keyword_sentences(docs: DataFrame, lexicon: LexiconTable) -> DataFrame:
    """Sentences that contain a term as a substring (``-`` and ``_`` read as blanks)."""
    needles = lexicon.terms.select(F.translate("term", "_", " ").alias("needle"))
    split = docs.select("doc_id", T.sentences(F.col("text")).alias("sents"))
    folded = F.array_join(F.transform("sents", lambda s: T.keyword_text(F.translate(s["sentence"], "\0", "\1"))), "\0")
    searched = _with_substrings(split.withColumn("folded", folded), "folded", needles).drop("folded")

    def sentence(f: Column) -> Column:
        s = F.get("sents", f["part"])
        return F.struct(s["sent_id"].alias("sent_id"), s["sentence"].alias("sentence"), f["runs"].alias("runs"))

    possible = searched.select("doc_id", F.explode(F.transform("found", sentence)).alias("s")).select("doc_id", "s.*")
    rows = settle(possible.withColumn("uid", F.monotonically_increasing_id()))
    asked = rows.select("uid", unnest("runs").alias("run"))
    held = asked.join(needles, F.col("run") == F.col("needle"), "left_semi").select("uid").distinct()
    return rows.join(held, "uid", "left_semi").select("doc_id", "sent_id", "sentence")


def find_examples(
    docs: DataFrame, lexicon: LexiconTable, shown: int = 100, missing: str = "no example in data"
) -> DataFrame:
    """Per term, the beginning of the first document that contains it anywhere."""
    needles = lexicon.terms.select(F.col("term").alias("needle"))
    lowered = docs.select("doc_id", F.substring("text", 1, shown).alias("excerpt"), F.lower("text").alias("low"))
    searched = _with_substrings(lowered, "low", needles).drop("low")
    runs = F.array_distinct(F.flatten(F.transform("found", lambda f: f["runs"])))
    held = searched.select("doc_id", "excerpt", F.explode(runs).alias("needle"))
    first = held.groupBy("needle").agg(F.min_by("excerpt", "doc_id").alias("excerpt"))
    return needles.join(first, "needle", "left").select(
        F.col("needle").alias("term"), F.coalesce("excerpt", F.lit(missing)).alias("example")
    )
