"""Line-first cleaning: rules per line, failing lines go, texts that lose too much are rejected.

Only SQL expressions over one row's arrays; nothing is shuffled and the plan has no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet.llm.common import WORD, let, text_or_empty, words

SYMBOLS = r"[#*$%&|<>]"
POSITION_BITS = 28


@dataclass(frozen=True)
class LineRules:
    """Limits of one line's rules, and the share of words a text may lose with its failing lines."""

    sentence_end: str = r"""[.!?…。？！]["'»”’)\]]*([\x20\x09-\x0D]|$)"""
    max_symbols_per_word: float = 0.5
    max_upper_share: float = 0.5
    separators: str = r"(^|[\x20\x09-\x0D])[|»›>·•/]($|(?=[\x20\x09-\x0D]))"
    min_separators: int = 3
    max_separator_share: float = 0.2
    boilerplate: str = (
        r"(?i)\b(lorem ipsum|enable javascript|javascript is (disabled|required)|accept (all )?cookies"
        r"|uses cookies|cookie (policy|settings)|skip to (main )?content|sign up for our newsletter)\b"
    )
    max_lost_share: float = 0.5


def _n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def _line_passes(line: Column, rules: LineRules) -> Column:
    """Each rule looks at one line; lines without a word always pass."""
    n = _n_words(line)
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    upper = F.regexp_count(line, F.lit(r"\p{Lu}"))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    separators = F.regexp_count(line, F.lit(rules.separators))
    return (n == 0) | (
        line.rlike(rules.sentence_end)
        & (symbols <= rules.max_symbols_per_word * n)
        & (upper <= rules.max_upper_share * letters)
        & ((separators < rules.min_separators) | (separators <= rules.max_separator_share * n))
        & ~line.rlike(rules.boilerplate)
    )


def repeated_window_words(tokens: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the array, each word once.

    Window hashes are sorted twice: first with their position packed in one number, which leaves
    the few windows whose leading bits occur again, then these by the whole 64-bit hash.
    """
    window = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: i < F.size(tokens) - 2),
        lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]),
    )

    def covered(hashes: Column) -> Column:
        mask = (1 << POSITION_BITS) - 1
        packed = F.array_sort(
            F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
        )

        def again(order: Column, same) -> Column:
            last = F.size(order) - 1
            return F.filter(
                order,
                lambda x, i: ((i > 0) & same(F.get(order, i - 1), x))
                | ((i < last) & same(F.get(order, i + 1), x)),
            )

        def lead(x: Column) -> Column:
            return F.shiftright(x, POSITION_BITS)

        def exact(near: Column) -> Column:
            keyed = F.transform(
                near,
                lambda x: F.struct(
                    F.get(hashes, x.bitwiseAND(F.lit(mask)).cast("int")).alias("h"),
                    x.bitwiseAND(F.lit(mask)).cast("int").alias("i"),
                ),
            )
            return let(
                F.sort_array(keyed),
                lambda order: F.array_sort(
                    F.transform(again(order, lambda a, b: a["h"] == b["h"]), lambda x: x["i"])
                ),
            )

        starts = let(packed, lambda p: exact(again(p, lambda a, b: lead(a) == lead(b))))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(tokens) < 4, F.lit(0).cast("long")).otherwise(
        let(window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def _judged(rules: LineRules, min_words: int) -> Column:
    """struct<rules, clean>: measures and decisions, and the text without its failing lines."""
    text = text_or_empty()
    lines = F.split(text, "\n")

    def measured(t: Column) -> Column:
        ends = F.filter(t["lines"], lambda line: line.rlike(WORD))
        passing = F.filter(t["lines"], lambda line: _line_passes(line, rules))
        return F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            repeated_window_words(t["words"]).alias("n_repeat_words"),
            (F.size(ends) - F.size(F.array_distinct(ends))).cast("long").alias("n_dup_lines"),
            F.array_join(passing, "\n").alias("clean"),
        )

    def decided(m: Column) -> Column:
        base_failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        lost = m["n_words"] - _n_words(m["clean"])
        return let(
            F.struct(base_failed.alias("failed"), lost.alias("lost")),
            lambda d: F.struct(
                F.struct(
                    m["n_words"].alias("n_words"),
                    (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
                    F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    m["n_dup_lines"].alias("n_dup_lines"),
                    m["n_repeat_words"].alias("n_repeat_words"),
                    d["lost"].alias("lost_words"),
                    d["failed"].alias("base_failed"),
                    (~d["failed"] & (d["lost"] <= rules.max_lost_share * m["n_words"])).alias("kept"),
                ).alias("rules"),
                m["clean"].alias("clean"),
            ),
        )

    parts = F.struct(lines.alias("lines"), words(text).alias("words"))
    return let(let(parts, measured), decided)


def line_quality(docs: DataFrame, rules: LineRules | None = None, min_words: int = 50) -> DataFrame:
    """All input columns, a struct ``rules`` of measures and decisions, and ``clean_text``.

    A null or empty text has no words and is rejected by ``min_words``.  ``clean_text`` is the text
    without its failing lines (null stays null).  A text is kept when the base rules hold and the
    failing lines hold at most ``max_lost_share`` of its words.  Repeated rows are judged alike;
    columns named ``rules`` or ``clean_text`` in the input are replaced.
    """
    judged = docs.drop("rules", "clean_text").select("*", _judged(rules or LineRules(), min_words).alias("__judged"))
    clean = F.when(F.col("text").isNotNull(), F.col("__judged.clean"))
    return judged.select(*judged.columns[:-1], "__judged.rules", clean.alias("clean_text"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row of measures and decisions per document; see ``line_quality`` for nulls and repeats."""
    judged = line_quality(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
    return judged.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in names])


def keep_clean(docs: DataFrame, rules: LineRules | None = None, min_words: int = 50) -> DataFrame:
    """Documents that pass, without their failing lines; columns as in ``docs``, whatever their names.

    The judgement is unnested where it says "kept": a filter on it would be pushed below and judge every
    text again.
    """
    kept = F.filter(F.array(_judged(rules or LineRules(), min_words)), lambda j: j["rules"]["kept"])
    passed = docs.select("*", F.explode(kept).alias("__judged"))
    new = {"text": F.col("__judged.clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__judged.clean").cast("long")
    return passed.select(*[new[c].alias(c) if c in new else passed[c] for c in docs.columns])
