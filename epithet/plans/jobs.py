"""The four stages as jobs that read and write tables under one root folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epithet import params
from epithet.operators import (
    classify,
    counts,
    lexicon_table,
    logodds,
    rules,
    sentences,
    similarity,
    stats,
)
from epithet.operators.lexicon_table import LexiconTable
from epithet.params import Lexicon, taxonomy_frame
from epithet.plans.stages import settle
from epithet.sources.tables import export_csv, read_table, replace_table, table_path

Annotator = Callable[[DataFrame, Lexicon | LexiconTable], DataFrame]


@dataclass(frozen=True)
class Study:
    """What is measured, and where its tables live."""

    root: str
    lexicon: Lexicon | LexiconTable
    taxonomy: Sequence[tuple[str, str | None, str | None]] = params.POPULATION_TAXONOMY
    category: str = "asian"
    poses: tuple[str, ...] = logodds.SCORED_POS
    min_count: int = logodds.MIN_COUNT

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return read_table(spark, self.root, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return replace_table(df, self.root, name)


def modifiers_of(
    docs: DataFrame,
    lexicon: Lexicon | LexiconTable,
    feed: str = "syntactic",
    annotator: Annotator | None = None,
    model: classify.Classifier | None = None,
    unit: str = "sentence",
) -> DataFrame:
    """Modifier sets per unit and group of a document table.

    With a model (any function that adds ``prediction`` to masked windows) only sentences whose
    window it accepts are used.  The feed is ``syntactic`` or ``window`` (words near the mention).  The
    syntactic feed needs an annotator, which adds ``toks`` to mention sentences: the parses of an outside
    parser (``annotate.external_annotate``) or of a table (``annotate.token_table_annotate``).
    """
    if feed not in ("syntactic", "window"):
        raise ValueError(f"feed must be 'syntactic' or 'window', not {feed!r}")
    if feed == "syntactic" and annotator is None:
        raise ValueError("the syntactic feed needs an annotator")
    tabled = isinstance(lexicon, LexiconTable)
    sents = (lexicon_table if tabled else sentences).mention_sentences(docs, lexicon)
    if model is not None:
        # Read twice by the model's join, so written once.
        windows = settle(sentences.masked_window(sents, keep=("sentence", "tokens", "overlap")))
        sents = classify.accepted(model(windows)).select(*sents.columns)
    if feed == "syntactic":
        found = rules.collect_modifiers(annotator(sents, lexicon))
    else:
        found = rules.window_modifiers(sents)
    return rules.fold_documents(found) if unit == "document" else found


def extract(docs: DataFrame, study: Study, **options) -> DataFrame:
    """Stage A: documents -> ``sentence_modifiers``."""
    return study.write(
        counts.modifier_rows(modifiers_of(docs, study.lexicon, **options)), "sentence_modifiers"
    )


def clean(spark: SparkSession, study: Study) -> DataFrame:
    """Stage B: ``sentence_modifiers`` -> ``clean_counts`` with category and region."""
    rows = study.table(spark, "sentence_modifiers")
    cleaned = counts.clean_counts(rows, study.lexicon)
    return study.write(
        counts.with_taxonomy(cleaned, taxonomy_frame(spark, study.taxonomy)), "clean_counts"
    )


def log_odds(spark: SparkSession, study: Study) -> DataFrame:
    """Stage C: ``clean_counts`` -> ``log_odds``, ``top_log_odds`` and two CSV reports."""
    scores = study.write(
        logodds.weighted_log_odds(
            study.table(spark, "clean_counts").select("grp", "pos", "term", "cnt"),
            min_count=study.min_count,
            poses=study.poses,
        ),
        "log_odds",
    )
    top = study.write(logodds.top_terms(scores), "top_log_odds")
    long = top.orderBy("grp", "pos", "rank").selectExpr("grp", "pos", "term", "score AS log_odds")
    export_csv(long, table_path(study.root, "top_log_odds_csv"))
    export_csv(logodds.joint_top(scores).orderBy("grp"), table_path(study.root, "top5_csv"))
    return top


def compare(spark: SparkSession, study: Study, vectors: DataFrame) -> None:
    """Stage D: similarities, contrasts and tests, from a (text, vector) table."""
    taxonomy = taxonomy_frame(spark, study.taxonomy)
    members = counts.members(taxonomy)
    top = study.table(spark, "top_log_odds")
    sims = study.write(similarity.term_category_similarity(top, members, vectors), "sim_vals")
    regional = stats.attach_region(sims, taxonomy, study.category)
    summary = study.write(stats.group_summary(regional), "group_summary")
    study.write(stats.region_stats(regional), "region_stats")
    study.write(stats.region_group_stats(summary), "region_group_stats")
    study.write(stats.global_group_stats(summary), "global_group_stats")
    study.write(stats.boxplot_table(sims, ["category", "pos"]), "category_boxes")

    docs = study.write(similarity.group_documents(top), "group_documents")
    categories = study.write(similarity.category_documents(docs, members), "category_documents")
    contrast = study.write(
        similarity.category_contrast(
            similarity.document_vectors(docs, "grp", vectors),
            similarity.document_vectors(categories, "category", vectors),
            members,
        ),
        "contrast_vals",
    )
    study.write(stats.category_contrast_stats(contrast), "contrast_stats")
    study.write(stats.alignment_contrast(contrast), "alignment_contrast")
