"""Sentence table, multiword merge, budget, group mentions and masked windows.

Everything up to the mention table is computed inside the document row, so the
text itself is never shuffled: one ``explode`` emits only what is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.functions.arrays import unnest
from epithet.params import Lexicon


def _tokenized(text: Column, lexicon: Lexicon | None = None) -> Column:
    """array<struct<sent_id, sentence, tokens>> of one document."""
    with_tokens = F.transform(
        T.sentences(text),
        lambda s: F.struct(s["sent_id"], s["sentence"], T.words(s["sentence"]).alias("tokens")),
    )
    if lexicon is None or not lexicon.multiword:
        return with_tokens
    return F.transform(
        with_tokens,
        lambda s: F.struct(
            s["sent_id"], s["sentence"], T.merge_terms(s["tokens"], lexicon).alias("tokens")
        ),
    )


def _explode(docs: DataFrame, sents: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(sents).alias("s")).select("doc_id", "s.*")


def split_sentences(docs: DataFrame, max_words: int | None = None) -> DataFrame:
    """Sentences of each document; ``max_words`` drops longer ones, which stall parsers."""
    return _explode(docs, T.sentences(F.col("text"), max_words))


def tokenize(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Lower-case tokens per sentence; with a lexicon, multiword terms are one token."""
    return _explode(docs, _tokenized(F.col("text"), lexicon))


def document_tokens(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All tokens of each document, multiword terms merged."""
    split = docs.select("doc_id", T.words(F.coalesce(F.col("text"), F.lit(""))).alias("_words"))
    return split.select("doc_id", T.merge_terms(F.col("_words"), lexicon).alias("tokens"))


def merge_multiword(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Sentences in which a multiword term was found, with the merged tokens."""
    many = list(lexicon.multiword)
    kept = F.filter(
        _tokenized(F.col("text"), lexicon),
        lambda s: F.arrays_overlap(s["tokens"], F.array(*map(F.lit, many))),
    )
    return _explode(docs, kept)


def _keyword_flags(text: Column, lexicon: Lexicon) -> Column:
    """array<struct<sent_id, sentence, is_keyword>>; the folded text is built once per sentence."""
    folded = F.transform(
        T.sentences(text),
        lambda s: F.struct(
            s["sent_id"], s["sentence"], T.keyword_text(s["sentence"]).alias("folded")
        ),
    )
    return F.transform(
        folded,
        lambda s: F.struct(
            s["sent_id"],
            s["sentence"],
            T.mentions_substring(s["folded"], lexicon).alias("is_keyword"),
        ),
    )


def keyword_sentences(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Sentences that contain a term as a substring (``-`` and ``_`` read as blanks)."""
    kept = F.filter(_keyword_flags(F.col("text"), lexicon), lambda s: s["is_keyword"])
    return _explode(docs, kept).drop("is_keyword")


def sentence_budget(
    docs: DataFrame,
    lexicon: Lexicon,
    max_filler: int,
    max_total: int,
) -> DataFrame:
    """Every keyword sentence, plus the first filler sentences of the document.

    Filler is limited to ``max_filler`` and to the room keyword sentences leave
    under ``max_total``; keyword sentences themselves are never dropped.
    """
    split = docs.select("doc_id", _keyword_flags(F.col("text"), lexicon).alias("all")).select(
        "doc_id",
        F.filter("all", lambda s: s["is_keyword"]).alias("kw"),
        F.filter("all", lambda s: ~s["is_keyword"]).alias("filler"),
    )
    room = F.greatest(F.lit(0), F.least(F.lit(max_filler), F.lit(max_total) - F.size("kw")))
    kept = split.select("doc_id", F.concat("kw", F.slice("filler", F.lit(1), room)).alias("kept"))
    return kept.select("doc_id", unnest("kept").alias("s")).select("doc_id", "s.*")


def mention_sentences(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Sentences whose tokens overlap the lexicon.

    Rows carry the sentence, its tokens and ``overlap``, the array of distinct terms in order of
    first occurrence.
    """
    with_overlap = F.transform(
        _tokenized(F.col("text"), lexicon),
        lambda s: F.struct(
            s["sent_id"],
            s["sentence"],
            s["tokens"],
            F.array_intersect(s["tokens"], F.array(*map(F.lit, lexicon.terms))).alias("overlap"),
        ),
    )
    return _explode(docs, F.filter(with_overlap, lambda s: F.size(s["overlap"]) > 0))


def representative(overlap: Column) -> Column:
    """First multiword term of the sentence, else its first term."""
    many = F.filter(overlap, lambda t: F.contains(t, F.lit("_")))
    return F.coalesce(F.get(many, F.lit(0)), F.get(overlap, F.lit(0)))


def group_mentions(sents: DataFrame) -> DataFrame:
    """Representative group and number of distinct groups per mention sentence."""
    return sents.select(
        "doc_id",
        "sent_id",
        representative(F.col("overlap")).alias("grp"),
        F.size("overlap").cast("bigint").alias("n_groups"),
    )


def mention_index(sents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Token position -> group, by surface form, one row per mention."""
    found = F.filter(
        F.transform(
            "tokens",
            lambda t, i: F.struct(i.cast("bigint").alias("i"), T.group_of(t, lexicon).alias("grp")),
        ),
        lambda m: m["grp"].isNotNull(),
    )
    return _explode_col(sents, found)


def _explode_col(sents: DataFrame, c: Column) -> DataFrame:
    return sents.select("doc_id", "sent_id", F.explode(c).alias("m")).select("doc_id", "sent_id", "m.*")


def window_around(tokens: Column, position: Column, window: int) -> Column:
    """Tokens from ``position - window`` to ``position + window`` (0-based), clipped."""
    start = F.greatest(F.lit(0), position - window)
    return F.slice(tokens, start + 1, position + window - start + 1)


def masked_window(
    sents: DataFrame,
    window: int = params.WINDOW,
    mask: str = params.MASK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Context window of the representative group's first occurrence, group masked.

    ``keep`` names input columns to carry along.
    """
    columns = ["doc_id", "sent_id", "tokens", *(c for c in keep if c != "tokens")]
    at = sents.select(*columns, representative(F.col("overlap")).alias("grp"))
    at = at.withColumn("at", (F.array_position("tokens", F.col("grp")) - 1).cast("int"))
    masked = F.transform("tokens", lambda t, i: F.when(i == F.col("at"), F.lit(mask)).otherwise(t))
    cut = window_around(masked, F.col("at"), window)
    return at.select(
        "doc_id",
        "sent_id",
        "grp",
        T.flatten_newlines(F.array_join(cut, " ")).alias("window_text"),
        *keep,
    )


def clean_lemmas(annotated: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Lower-case lemmas of the alphabetic tokens that are not stop words."""
    kept = F.filter(
        "toks",
        lambda t: F.lower(t["text"]).rlike(r"^\p{L}+$") & ~F.lower(t["text"]).isin(list(stop_words)),
    )
    return annotated.select(
        "doc_id", "sent_id", F.transform(kept, lambda t: F.lower(t["lemma"])).alias("lemmas")
    )
