"""Count tables: modifier rows, additive merges, cleaning, totals, taxonomy.

Counts are kept in long form (group, pos, term, cnt) and are always aggregated on a
key that includes the term, so a frequent group spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.operators.lexicon_table import LexiconTable
from epithet.params import Lexicon

MODIFIER_KEY = ("grp", "adjs", "verbs", "nouns")


def modifier_rows(modifiers: DataFrame) -> DataFrame:
    """Identical modifier sets of a group counted; rows with neither verb nor adjective dropped."""
    kept = modifiers.where(F.size("verbs") + F.size("adjs") > 0)
    canonical = kept.select(
        "grp", *[F.array_sort(F.array_distinct(c)).alias(c) for c in MODIFIER_KEY[1:]]
    )
    counted = canonical.groupBy(*MODIFIER_KEY).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("has_dup", F.col("cnt") > 1)


def merge_modifier_rows(*tables: DataFrame) -> DataFrame:
    """Upsert: rows of all tables added up by modifier set."""
    merged = add_counts(MODIFIER_KEY, *[t.select(*MODIFIER_KEY, "cnt") for t in tables])
    return merged.withColumn("has_dup", F.col("cnt") > 1)


def add_counts(key: Sequence[str], *tables: DataFrame) -> DataFrame:
    """Additive upsert of count tables: union, then sum per key."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(*key).agg(F.sum("cnt").alias("cnt"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """Documents in which a (group, pos, term) occurs, from (doc_id, grp, pos, term) rows."""
    once = terms.select("doc_id", "grp", "pos", "term").distinct()
    return once.groupBy("grp", "pos", "term").agg(F.count(F.lit(1)).alias("cnt"))


def as_text_rows(rows: DataFrame) -> DataFrame:
    """Modifier rows with their lists as JSON text, the stored form of older tables."""
    return rows.select(
        "grp", *[T.list_text(F.col(c)).alias(c) for c in MODIFIER_KEY[1:]], "cnt"
    )


def parse_text_rows(rows: DataFrame, aliases=params.GROUP_ALIASES) -> DataFrame:
    """Modifier rows read from their text form, group names normalised."""
    return rows.select(
        T.normalize_group(F.col("grp"), aliases).alias("grp"),
        *[T.parse_list(F.col(c)).alias(c) for c in MODIFIER_KEY[1:]],
        "cnt",
    )


def clean_counts(
    rows: DataFrame,
    lexicon: Lexicon | LexiconTable,
    aliases=params.GROUP_ALIASES,
    substrings=params.GROUP_SUBSTRINGS,
) -> DataFrame:
    """Long-form counts weighted by row count; adjectives and verbs filtered, nouns not.

    Terms that a lexicon table holds are taken out by an anti join of the counted terms, after the
    counts are added up.
    """

    def labelled(pos: str, column: str):
        return F.transform(column, lambda t: F.struct(F.lit(pos).alias("pos"), t.alias("term")))

    every = F.concat(labelled("adj", "adjs"), labelled("verb", "verbs"), labelled("noun", "nouns"))
    long = rows.select(
        T.normalize_group(F.col("grp"), aliases).alias("grp"), "cnt", F.explode(every).alias("x")
    ).select("grp", "x.pos", F.coalesce(T.clean_utf8(F.col("x.term")), F.lit("")).alias("term"), "cnt")
    term, noun = F.col("term"), F.col("pos") == "noun"
    tabled = isinstance(lexicon, LexiconTable)
    dropped = T.stopped_term(term) | T.names_group(term, F.col("grp"), None if tabled else lexicon, substrings)
    counted = long.where(noun | ~dropped).groupBy("grp", "pos", "term").agg(F.sum("cnt").alias("cnt"))
    if not tabled:
        return counted
    named = lexicon.terms.select(F.col("term").alias("named"))
    return counted.join(named, (F.col("term") == F.col("named")) & ~noun, "left_anti")


def screen_terms(terms: DataFrame) -> DataFrame:
    """Distinct terms with their cleaned spelling and what the term filters say."""
    distinct = terms.select("term").distinct()
    cleaned = T.clean_term(F.col("term"))
    return distinct.select(
        "term",
        cleaned.alias("cleaned"),
        T.is_directional(F.col("term")).alias("is_directional"),
        T.stopped_term(F.col("term")).alias("is_stopped"),
    )


def global_counts(counts: DataFrame) -> DataFrame:
    """Counts per (pos, term) over all groups."""
    return counts.groupBy("pos", "term").agg(F.sum("cnt").alias("cnt"))


def max_counts(counts: DataFrame, groups: DataFrame, pos: str = "adj") -> DataFrame:
    """Largest count per group; 0 for a group without terms of that kind."""
    best = counts.where(F.col("pos") == pos).groupBy("grp").agg(F.max("cnt").alias("max_cnt"))
    return groups.join(best, "grp", "left").select(
        "grp", F.coalesce("max_cnt", F.lit(0)).cast("bigint").alias("max_cnt")
    )


def vocabulary_sizes(counts: DataFrame, everywhere: str = "*") -> DataFrame:
    """Distinct terms per (group, pos), and per pos over all groups (``grp`` = ``*``), in one pass."""
    sets = [[F.col("grp"), F.col("pos")], [F.col("pos")]]
    sizes = counts.groupingSets(sets, "grp", "pos").agg(
        F.count_distinct("term").alias("n_terms"), F.grouping("grp").alias("_joint")
    )
    named = F.when(F.col("_joint") == 1, F.lit(everywhere)).otherwise(F.col("grp"))
    return sizes.select(named.alias("grp"), "pos", "n_terms")


def counter_maps(counts: DataFrame, shards: int) -> DataFrame:
    """Counters as map columns, a fixed number of ``shards`` by term hash for each (group, pos).

    Choose ``shards`` so that a vocabulary divided by it fits in one row; for more than that,
    use the counts in their long form.
    """
    entries = F.array_sort(F.collect_list(F.struct("term", "cnt")))
    return (
        counts.withColumn("shard", T.hash_number(F.col("term")) % shards)
        .groupBy("grp", "pos", "shard")
        .agg(F.map_from_entries(entries).alias("counter"))
    )


def counter_rows(maps: DataFrame) -> DataFrame:
    """Long form of counter maps."""
    return maps.select("grp", "pos", F.explode("counter").alias("term", "cnt"))


def with_taxonomy(df: DataFrame, taxonomy: DataFrame, on: str = "grp") -> DataFrame:
    """Category and region of each group; null where the taxonomy has none."""
    names = taxonomy.select(F.col("term").alias(on), "category", "region")
    return df.join(names, on, "left")


def members(taxonomy: DataFrame) -> DataFrame:
    """(grp, category) of the groups that have a category."""
    return (
        taxonomy.where(F.col("category").isNotNull())
        .select(F.col("term").alias("grp"), "category")
        .distinct()
    )
