"""Column functions on text, tokens and term strings.  All run in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from epithet import params
from epithet.functions.arrays import let
from epithet.params import Lexicon

# The white space characters that a Unicode-aware split and strip
# honour, as the inside of a character class.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A sentence: text between runs of ``.!?``, from its first to its last visible character.
SENTENCE_RUN = f"[^.!?{SPACE}](?:[^.!?]*[^.!?{SPACE}])?"
WORD_RUN = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def within_words(c: Column, limit: int) -> Column:
    """At most ``limit`` words in a stripped string (words are only counted if it is long)."""
    return (F.length(c) <= 2 * limit) | (F.regexp_count(c, F.lit(f"[{SPACE}]+")) < limit)


def sentences(text: Column, max_words: int | None = None) -> Column:
    """array<struct<sent_id, sentence>>: punctuation runs split, blank ones dropped.

    With ``max_words``, sentences of more words are dropped as well.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_RUN), F.lit(0))
    numbered = F.transform(
        runs, lambda s, i: F.struct(i.cast("bigint").alias("sent_id"), s.alias("sentence"))
    )
    if max_words is None:
        return numbered
    return F.filter(numbered, lambda s: within_words(s["sentence"], max_words))


def words(text: Column) -> Column:
    """Lower-case word tokens; ``_`` is a word character."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def merge_terms(tokens: Column, lexicon: Lexicon) -> Column:
    """Join neighbouring tokens that spell a multiword term (leftmost, then longest).

    At each token that may begin a term, the runs of every length that terms have are looked up in
    hashed sets, so the cost grows with the longest term and not with the number of terms.
    """
    if not lexicon.multiword:
        return tokens
    heads = sorted({t.split("_")[0] for t in lexicon.multiword})
    by_size: dict[int, list[str]] = {}
    for term in lexicon.multiword:
        by_size.setdefault(term.count("_") + 1, []).append(term)

    def run(i: Column, k: Column | int) -> Column:
        return F.array_join(F.slice(tokens, i + 1, k), "_")

    def longest(i: Column) -> Column:
        sizes = sorted(by_size, reverse=True)
        found = F.when(run(i, sizes[0]).isin(by_size[sizes[0]]), F.lit(sizes[0]))
        for k in sizes[1:]:
            found = found.when(run(i, k).isin(by_size[k]), F.lit(k))
        return found

    def spans(positions: Column) -> Column:
        hits = F.transform(positions, lambda i: F.struct(i.alias("i"), longest(i).alias("k")))
        return leftmost_spans(F.filter(hits, lambda h: h["k"].isNotNull()))

    def merged(positions: Column) -> Column:
        return let(spans(positions), lambda taken: merge_spans(tokens, taken))

    starts = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(heads), i)), lambda i: i.isNotNull())
    # Most texts hold no first word of a term and stay as they are.
    possible = F.arrays_overlap(tokens, F.array(*map(F.lit, heads)))
    return F.when(possible, let(starts, merged)).otherwise(tokens)


def leftmost_spans(spans: Column) -> Column:
    """Of array<struct<i, k>> ordered by place, longest first, those that overlap no earlier one."""
    end = lambda h: h["i"] + h["k"]
    return F.aggregate(
        spans,
        F.array().cast("array<struct<i:int,k:int>>"),
        lambda got, h: F.when(end(F.try_element_at(got, F.lit(-1))) > h["i"], got).otherwise(F.array_append(got, h)),
    )


def merge_spans(tokens: Column, spans: Column) -> Column:
    """Each span of ``k`` tokens from place ``i`` made one token, words joined by ``_``."""
    end = lambda h: h["i"] + h["k"]

    def piece(h: Column, r: Column) -> Column:
        begin = F.coalesce(end(F.get(spans, r - 1)), F.lit(0))
        joined = F.array_join(F.slice(tokens, h["i"] + 1, h["k"]), "_")
        return F.concat(F.slice(tokens, begin + 1, h["i"] - begin), F.array(joined))

    last = end(F.element_at(spans, -1))
    rest = F.slice(tokens, last + 1, F.size(tokens) - last)
    return F.when(F.size(spans) == 0, tokens).otherwise(F.concat(F.flatten(F.transform(spans, piece)), rest))


def is_term(token: Column, lexicon: Lexicon) -> Column:
    return token.isin(list(lexicon.terms))


def group_of(token: Column, lexicon: Lexicon) -> Column:
    """Group named by a surface form (exact or naive plural), else null."""
    hit = F.when(token.isin(list(lexicon.terms)), token)
    if lexicon.plurals:
        hit = hit.when(token.isin(list(lexicon.plurals)), chop(token, 1))
    return hit


def group_in(token: Column, overlap: Column) -> Column:
    """Like ``group_of``, for a lexicon that is the row's own array of terms."""
    stem = chop(token, 1)
    plural = token.endswith("s") & ~stem.endswith("s") & F.array_contains(overlap, stem)
    return F.when(F.array_contains(overlap, token), token).when(plural, stem)


def chop(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def mentions_substring(text: Column, lexicon: Lexicon) -> Column:
    """True where any term (``_`` read as a space) is a substring of the text."""
    needles = F.array(*[F.lit(t.replace("_", " ")) for t in lexicon.terms])
    return F.exists(needles, lambda t: F.contains(text, t))


def normalize_form(c: Column) -> Column:
    """A token's text as lexicon terms are written."""
    return F.translate(F.lower(c), "- ", "__")


def keyword_text(c: Column) -> Column:
    return F.translate(F.lower(c), "-_", "  ")


def flatten_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n", " "))


# ---------------------------------------------------------------------------
# Term strings
# ---------------------------------------------------------------------------


@cache
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions to ASCII of all characters: one-letter and longer ones."""
    single, longer = {}, {}
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        # Without a decomposition a character beyond ASCII leaves nothing.
        if not unicodedata.decomposition(ch):
            continue
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode().strip()
        if len(folded) == 1 and (folded.isalpha() or folded == "-"):
            single[ch] = folded
        elif any(c.isalpha() or c == "-" for c in folded):
            longer[ch] = folded
    return single, longer


def ascii_fold(c: Column) -> Column:
    """NFKD to ASCII for the characters that decompose to letters or ``-``."""
    single, longer = _ascii_folds()
    folded = F.translate(c, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    spelled = F.array_join(
        F.transform(F.split(folded, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    return F.when(folded.rlike("[" + "".join(map(re.escape, longer)) + "]"), spelled).otherwise(folded)


def clean_term(c: Column, collapse_hyphens: bool = False) -> Column:
    """Accents folded, lower case, only ``a-z`` and ``-`` kept."""
    needs_fold = c.rlike(r"[^\x00-\x7F]")
    plain = F.when(needs_fold, ascii_fold(c)).otherwise(c)
    out = F.regexp_replace(F.lower(plain), r"[^a-z\-]", "")
    return F.replace(out, F.lit("--"), F.lit("-")) if collapse_hyphens else out


def is_directional(c: Column) -> Column:
    return c.rlike("|".join(params.COMPASS_WORDS))


def stopped_term(c: Column) -> Column:
    """Too short, a direction, or a noise word."""
    return (F.length(c) <= 2) | c.isin([*params.DIRECTION_STOP, *params.NOISE_STOP])


def names_group(
    term: Column, grp: Column, lexicon: Lexicon | None, substrings=params.GROUP_SUBSTRINGS
) -> Column:
    """Contains the group's own name or a marker substring, or is a term of the lexicon (if given).

    ``_`` is dropped on both sides; blanks in a multiword group name are not.
    """
    t = F.replace(F.lower(term), F.lit("_"), F.lit(""))
    own = F.contains(t, F.replace(F.lower(grp), F.lit("_"), F.lit("")))
    marks = [F.contains(t, F.lit(s)) for s in substrings]
    found = reduce(lambda a, b: a | b, marks, own)
    return found | term.isin(list(lexicon.terms)) if lexicon else found


def parse_list(c: Column) -> Column:
    """Text of a string list (single or double quotes) -> array; unreadable -> empty.

    Literals that JSON lacks are read as well: ``None`` (null), a comma after the last element and
    ``\\x..`` escapes.
    """
    literal = F.regexp_replace(c, r",[\s]*\]\s*$", "]")
    literal = F.regexp_replace(literal, r"(?<=[\[,])(\s*)None(?=\s*[,\]])", "$1null")
    literal = F.regexp_replace(literal, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    read = F.coalesce(F.from_json(c, "array<string>"), F.from_json(literal, "array<string>"))
    return F.coalesce(read, F.array().cast("array<string>"))


def list_text(c: Column) -> Column:
    """Sorted distinct list as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(c)))


def normalize_group(c: Column, aliases=params.GROUP_ALIASES) -> Column:
    name = F.trim(F.lower(F.translate(c, "_", " ")))
    out = F.when(F.lit(False), name)
    for old, new in aliases:
        out = out.when(name == old, F.lit(new))
    return out.otherwise(name)


def clean_utf8(c: Column) -> Column:
    return F.make_valid_utf8(c)


def hash_number(c: Column) -> Column:
    """First 32 bits of the md5 of a string, as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
