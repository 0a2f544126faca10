"""Document taggers, the score filter, example finder and attribute profile."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet.functions import text as T
from epithet.params import Lexicon, lexicon_frame

# A tagger adds ``spans``: array<struct<start, end, type, score>>.
Tagger = Callable[[DataFrame, Lexicon], DataFrame]
_TAGGERS: dict[str, Tagger] = {}


def tagger(name: str) -> Callable[[Tagger], Tagger]:
    """Register a tagger under a name."""

    def add(fn: Tagger) -> Tagger:
        _TAGGERS[name] = fn
        return fn

    return add


def apply_tagger(name: str, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    if name not in _TAGGERS:
        raise KeyError(f"no tagger named {name!r}; known: {sorted(_TAGGERS)}")
    return _TAGGERS[name](docs, lexicon)


def _phrases(text: Column, words: Column, lexicon: Lexicon, gap: str) -> Column:
    """Distinct surface strings of the multiword terms, words separated by ``gap``.

    The pattern lists every multiword term, so it is only tried on documents that have
    the first word of one (a hashed lookup per token).
    """
    none = F.array().cast("array<string>")
    if not lexicon.multiword:
        return none
    heads = sorted({t.split("_")[0] for t in lexicon.multiword})
    spelled = "|".join(gap.join(map(re.escape, t.split("_"))) for t in lexicon.multiword)
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{spelled})(?![\p{{L}}\p{{N}}_])"
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
    possible = F.exists(words, lambda w: F.substring_index(w, "_", 1).isin(heads))
    return F.when(possible, found).otherwise(none)


def _span(text: Column, score: Column) -> Column:
    hit = score > 0
    return F.array(
        F.struct(
            F.lit(0).alias("start"),
            F.when(hit, F.length(text)).otherwise(0).alias("end"),
            F.lit("lexicon").alias("type"),
            score.cast("double").alias("score"),
        )
    )


def _tagged(docs: DataFrame, lexicon: Lexicon, gap: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    singles = [t for t in lexicon.terms if "_" not in t]
    staged = docs.select("*", T.words(text).alias("_words"))
    hits = F.array_distinct(F.filter("_words", lambda w: w.isin(singles)))
    score = F.size(hits) + F.size(_phrases(text, F.col("_words"), lexicon, gap))
    scored = staged.select(*docs.columns, score.alias("_score"))
    return scored.select(*docs.columns, _span(text, F.col("_score")).alias("spans"))


@tagger("lexicon_tolerant")
def tag_tolerant(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score = distinct matched strings; blanks, ``-`` or ``_`` may separate words."""
    return _tagged(docs, lexicon, r"[-_\s]+")


@tagger("lexicon_exact")
def tag_exact(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score = distinct terms found as exact phrases with single blanks."""
    return _tagged(docs, lexicon, " ")


def span_score(tagged: DataFrame) -> DataFrame:
    return tagged.withColumn("score", F.coalesce(F.get("spans", F.lit(0))["score"], F.lit(0.0)))


def _positive(spans: str = "spans") -> Column:
    return F.filter(spans, lambda s: s["score"] > 0)


def mix(tagged: DataFrame) -> DataFrame:
    """Documents with a positive score: id, text, score.

    Unnesting the positive span drops the others; a filter on the score would be pushed
    below the tagger and tokenise every document twice.
    """
    first = F.slice(_positive(), 1, 1)
    return tagged.select("doc_id", "text", F.explode(first).alias("s")).select(
        "doc_id", "text", "s.score"
    )


def find_examples(
    docs: DataFrame, lexicon: Lexicon, shown: int = 100, missing: str = "no example in data"
) -> DataFrame:
    """Per term, the beginning of the first document that contains it anywhere.

    The document's own text decides which terms it holds, so only (term, doc_id,
    excerpt) reaches the aggregation, where ``min_by`` combines before the shuffle.
    """
    needles = F.array(*[F.lit(t) for t in lexicon.terms])
    lowered = docs.select("doc_id", "text", F.lower("text").alias("low"))
    held = lowered.select(
        "doc_id",
        F.substring("text", 1, shown).alias("excerpt"),
        F.explode(F.filter(needles, lambda t: F.contains(F.col("low"), t))).alias("term"),
    )
    first = held.groupBy("term").agg(F.min_by("excerpt", "doc_id").alias("excerpt"))
    terms = lexicon_frame(docs.sparkSession, lexicon).where("surface = grp")
    return terms.select(F.col("surface").alias("term")).join(first, "term", "left").select(
        "term", F.coalesce("excerpt", F.lit(missing)).alias("example")
    )


def with_attributes(tagged: DataFrame) -> DataFrame:
    """Records whose span list holds something: a span with a positive score."""
    first = F.slice(_positive(), 1, 1)
    return tagged.select(*tagged.columns, F.explode(first).alias("_s")).drop("_s")


def attribute_profile(tagged: DataFrame, by: str) -> DataFrame:
    """Records read and records with attributes, per ``by``."""
    filled = F.exists("spans", lambda s: s["score"] > 0)
    return tagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(filled).alias("n_with_attributes")
    )
