"""Registered queries: each operator over the whole generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epithet import params
from epithet.functions import text as T
from epithet.functions.vectors import mean_pool
from epithet.operators import (
    annotate,
    classify,
    counts,
    lexicon_table,
    logodds,
    rules,
    sentences,
    similarity,
    stats,
    tagging,
    variants,
)
from epithet.params import TEST_LEXICON as LEX
from epithet.params import Lexicon, lexicon_frame, local_frame, taxonomy_frame
from epithet.plans.stages import settle
from epithet.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CATEGORY = "alpha"
TARGETS = ("thon", "than")
POSES = ("adj", "verb", "noun")
# Similarity queries keep rarer terms, so that all three test categories have some.
SIMILARITY_MIN_COUNT = 2
# Lexicon of the older collectors, which add a plural to every term.
OLD_LEX = Lexicon(LEX.terms, always_plural=True)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- building blocks -------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """``spark.epithet.documents.partitions`` says how many tasks should share files that can't be split."""
    asked = spark.conf.get("spark.epithet.documents.partitions", None)
    return corpus.documents(_table(spark, sf, "documents"), int(asked) if asked else None)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations")
    doc_id = F.concat_ws(":", "conv_id", "turn").alias("doc_id")
    return turns.select(doc_id, "text")


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.mention_sentences(_docs(spark, sf), LEX)


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.surface_annotate(_mentions(spark, sf), LEX)


def _syntactic(spark: SparkSession, sf: str) -> DataFrame:
    return rules.collect_modifiers(_annotated(spark, sf))


def _window_rows(spark: SparkSession, sf: str) -> DataFrame:
    return counts.modifier_rows(rules.window_modifiers(_mentions(spark, sf), LEX))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.clean_counts(_window_rows(spark, sf), LEX)


def _scores(spark: SparkSession, sf: str, min_count: int = logodds.MIN_COUNT) -> DataFrame:
    return logodds.weighted_log_odds(settle(_counts(spark, sf)), min_count=min_count, poses=POSES)


def _top(spark: SparkSession, sf: str, min_count: int = logodds.MIN_COUNT) -> DataFrame:
    return logodds.top_terms(settle(_scores(spark, sf, min_count)))


def _vectors(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    """(text, vector): every distinct text is given one vector of ``embeddings`` by hash."""
    emb = _table(spark, sf, "embeddings")
    n_vectors = emb.select(F.count(F.lit(1))).scalar()
    keyed = texts.distinct().withColumn("vec_id", T.hash_number(F.col("text")) % n_vectors)
    vectors = emb.select("vec_id", F.col("embedding").alias("vector"))
    return keyed.join(vectors, "vec_id").select("text", "vector")


def _lexicon_table(spark: SparkSession) -> lexicon_table.LexiconTable:
    return lexicon_table.LexiconTable.of(local_frame(spark, [(t,) for t in LEX.terms], ("term",)))


def _members(spark: SparkSession) -> DataFrame:
    return counts.members(taxonomy_frame(spark))


def _similarities(spark: SparkSession, sf: str) -> DataFrame:
    top, members = settle(_top(spark, sf, SIMILARITY_MIN_COUNT)), _members(spark)
    texts = top.select(F.col("term").alias("text")).union(members.select("category"))
    return similarity.term_category_similarity(top, members, _vectors(spark, sf, texts))


def _contrast(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark)
    docs = settle(similarity.group_documents(_top(spark, sf, SIMILARITY_MIN_COUNT)))
    categories = similarity.category_documents(docs, members)
    vectors = settle(_vectors(spark, sf, docs.select(F.explode("terms").alias("text"))))
    return similarity.category_contrast(
        similarity.document_vectors(docs, "grp", vectors),
        similarity.document_vectors(categories, "category", vectors),
        members,
    )


def _regional(spark: SparkSession, sf: str) -> DataFrame:
    return stats.attach_region(_similarities(spark, sf), taxonomy_frame(spark), CATEGORY)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.group_summary(_regional(spark, sf))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _joined(c: str, sep: str = " "):
    return F.array_join(c, sep)


# --- scans, lexicon, tagging ----------------------------------------------


@query
def corpus_scan(spark, sf):
    """Documents and characters per source."""
    docs = corpus.documents(_table(spark, sf, "documents"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars")
    )


@query
def lexicon(spark, sf):
    """Every surface form of the lexicon with its group and corpus frequency."""
    tokens = sentences.tokenize(_docs(spark, sf), LEX)
    hits = F.filter("tokens", lambda t: t.isin(list(LEX.surfaces)))
    seen = tokens.select(F.explode(hits).alias("surface")).groupBy("surface").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return lexicon_frame(spark, LEX).join(seen, "surface", "left").select(
        "surface", "grp", "n_words", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


@query
def taxonomy(spark, sf):
    """Taxonomy entries with the mention sentences of each group."""
    seen = (
        sentences.group_mentions(_mentions(spark, sf))
        .groupBy(T.normalize_group(F.col("grp")).alias("term"))
        .agg(F.count(F.lit(1)).alias("n_sentences"))
    )
    return taxonomy_frame(spark).join(seen, "term", "left").select(
        "term", "category", "region", F.coalesce("n_sentences", F.lit(0)).cast("bigint").alias("n_sentences")
    )


@query
def doc_tag_score(spark, sf):
    tagged = tagging.apply_tagger("lexicon_tolerant", _docs(spark, sf), LEX)
    return tagging.span_score(tagged).select("doc_id", "score")


@query
def doc_tag_score_exact(spark, sf):
    tagged = tagging.apply_tagger("lexicon_exact", _docs(spark, sf), LEX)
    return tagging.span_score(tagged).select("doc_id", "score")


@query
def doc_mix(spark, sf):
    return tagging.mix(tagging.apply_tagger("lexicon_tolerant", _docs(spark, sf), LEX))


@query
def attr_profile(spark, sf):
    tagged = tagging.apply_tagger("lexicon_tolerant", _docs(spark, sf), LEX)
    return tagging.attribute_profile(tagged, "source")


@query
def example_finder(spark, sf):
    return tagging.find_examples(_docs(spark, sf), LEX)


# --- text preparation ------------------------------------------------------


@query
def sentence_split(spark, sf):
    return sentences.split_sentences(_docs(spark, sf), params.MAX_SENTENCE_WORDS)


@query
def tokens(spark, sf):
    toks = sentences.tokenize(_docs(spark, sf), LEX)
    return toks.select(
        "doc_id", "sent_id", _joined("tokens").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens")
    )


@query
def multiword_merge(spark, sf):
    merged = sentences.merge_multiword(_docs(spark, sf), LEX)
    return merged.select("doc_id", "sent_id", _joined("tokens").alias("tokens"))


@query
def keyword_sentences(spark, sf):
    return sentences.keyword_sentences(_docs(spark, sf), LEX)


@query
def sentence_budget(spark, sf):
    return sentences.sentence_budget(
        _docs(spark, sf), LEX, params.MAX_FILLER_SENTENCES, params.MAX_DOC_SENTENCES
    )


@query
def group_mentions(spark, sf):
    return sentences.group_mentions(_mentions(spark, sf))


@query
def table_mentions(spark, sf):
    """The same with the lexicon as a table that is joined."""
    sents = lexicon_table.mention_sentences(_docs(spark, sf), _lexicon_table(spark))
    return sentences.group_mentions(sents)


@query
def table_keywords(spark, sf):
    """Keyword sentences with the lexicon as a table that is joined."""
    return lexicon_table.keyword_sentences(_docs(spark, sf), _lexicon_table(spark))


@query
def table_examples(spark, sf):
    """Examples with the lexicon as a table that is joined."""
    return lexicon_table.find_examples(_docs(spark, sf), _lexicon_table(spark))


@query
def mention_index(spark, sf):
    return sentences.mention_index(_mentions(spark, sf), LEX)


@query
def mention_cache(spark, sf):
    """Mentions by text, else by lemma."""
    return variants.mention_cache(_annotated(spark, sf), LEX)


@query
def masked_window(spark, sf):
    return sentences.masked_window(_mentions(spark, sf))


@query
def clean_lemmas(spark, sf):
    out = sentences.clean_lemmas(_annotated(spark, sf), params.FUNCTION_WORDS)
    return out.select("doc_id", "sent_id", _joined("lemmas").alias("lemmas"))


@query
def clean_terms(spark, sf):
    toks = sentences.tokenize(_docs(spark, sf))
    return counts.screen_terms(toks.select(F.explode("tokens").alias("term")))


@query
def parse_lists(spark, sf):
    """Modifier rows through their text form and back, lists joined for display."""
    parsed = counts.parse_text_rows(counts.as_text_rows(_window_rows(spark, sf)))
    return parsed.select("grp", *[_joined(c, "|").alias(c) for c in counts.MODIFIER_KEY[1:]], "cnt")


@query
def annotate_tokens(spark, sf):
    rows = annotate.token_rows(_annotated(spark, sf))
    return rows.select(
        "doc_id", "sent_id", F.col("i").cast("bigint").alias("i"), "text", "lemma", "pos", "tag", "dep",
        F.col("head").cast("bigint").alias("head"), "ent",
    )


QUERIES["annotate"] = QUERIES.pop("annotate_tokens")


# --- extraction ------------------------------------------------------------


def _modifier_counts(spark, sf, column: str) -> DataFrame:
    mods = rules.collect_modifiers(_annotated(spark, sf), kinds=(column,))
    return (
        mods.select("grp", F.explode(column).alias("term"))
        .groupBy("grp", "term")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


@query
def mod_nouns(spark, sf):
    return _modifier_counts(spark, sf, "nouns")


@query
def mod_verbs(spark, sf):
    return _modifier_counts(spark, sf, "verbs")


@query
def mod_adjs(spark, sf):
    return _modifier_counts(spark, sf, "adjs")


@query
def sentence_modifiers(spark, sf):
    rows = counts.modifier_rows(_syntactic(spark, sf))
    return rows.select("grp", *[T.list_text(F.col(c)).alias(c) for c in counts.MODIFIER_KEY[1:]], "cnt", "has_dup")


@query
def document_modifiers(spark, sf):
    """The same with documents as units."""
    rows = counts.modifier_rows(rules.fold_documents(_syntactic(spark, sf)))
    return rows.select("grp", *[T.list_text(F.col(c)).alias(c) for c in counts.MODIFIER_KEY[1:]], "cnt", "has_dup")


# --- earlier collectors ----------------------------------------------------


@query
def pos_noun_counts(spark, sf):
    return variants.count_nouns(_annotated(spark, sf), LEX)


@query
def pos_verb_counts(spark, sf):
    return variants.count_verbs(_annotated(spark, sf), LEX)


@query
def pos_adj_counts(spark, sf):
    return variants.count_adjectives(_annotated(spark, sf), LEX)


@query
def subject_of(spark, sf):
    return variants.predicate_subjects(_annotated(spark, sf))


@query
def subtree_adj_counts(spark, sf):
    return variants.subtree_adjectives(_annotated(spark, sf), OLD_LEX)


@query
def subtree_verb_counts(spark, sf):
    return variants.subtree_verbs(_annotated(spark, sf), OLD_LEX, use_fallback=True)


@query
def first_modified_noun(spark, sf):
    return variants.first_modified_nouns(_annotated(spark, sf), LEX)


@query
def norp_verb_counts(spark, sf):
    return variants.norp_verbs(_annotated(spark, sf), LEX)


@query
def norp_adj_counts(spark, sf):
    return variants.norp_adjectives(_annotated(spark, sf), LEX)


@query
def entity_counts(spark, sf):
    return variants.entity_counts(_annotated(spark, sf), LEX)


@query
def edge_match(spark, sf):
    return variants.match_edges(_annotated(spark, sf))


# --- classification --------------------------------------------------------


@query
def window_classify(spark, sf):
    """Accepted windows; the model is fitted to the windows of all labelled documents."""
    windows = settle(sentences.masked_window(_mentions(spark, sf)))
    labels = _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = classify.fit_windows(windows.join(labels, "doc_id"))
    return classify.accepted(classify.classify_windows(windows, model))


@query
def mention_pass_counts(spark, sf):
    """Mentions before and after a rule: windows of at least six words pass."""
    windows = sentences.masked_window(_mentions(spark, sf))
    long_enough = F.size(F.split("window_text", " ")) >= 6
    return classify.pass_counts(classify.classify_by_rule(windows, long_enough))


# --- counts ----------------------------------------------------------------


@query
def doc_freq_counts(spark, sf):
    mods = rules.window_modifiers(_mentions(spark, sf), LEX)
    return counts.document_frequency(rules.modifier_terms(mods))


@query
def upsert_counts(spark, sf):
    """Count tables of two corpora added up."""
    turns = sentences.mention_sentences(_turns(spark, sf), LEX)
    new = counts.clean_counts(counts.modifier_rows(rules.window_modifiers(turns, LEX)), LEX)
    return counts.add_counts(("grp", "pos", "term"), _counts(spark, sf), new)


@query
def merge_modifiers(spark, sf):
    """Modifier tables of two corpora added up."""
    turns = sentences.mention_sentences(_turns(spark, sf), LEX)
    new = counts.modifier_rows(rules.window_modifiers(turns, LEX))
    merged = counts.merge_modifier_rows(_window_rows(spark, sf), new)
    return merged.select("grp", *[_joined(c, "|").alias(c) for c in counts.MODIFIER_KEY[1:]], "cnt", "has_dup")


@query
def clean_counts(spark, sf):
    return _counts(spark, sf)


@query
def syntactic_counts(spark, sf):
    """Clean counts of the syntactic collectors' modifiers."""
    return counts.clean_counts(counts.modifier_rows(_syntactic(spark, sf)), LEX)


@query
def syntactic_log_odds(spark, sf):
    """Log-odds of the syntactic counts; rarer terms are kept than in the window feed."""
    scored = logodds.weighted_log_odds(
        settle(syntactic_counts(spark, sf)), min_count=SIMILARITY_MIN_COUNT, poses=POSES
    )
    return _rounded(scored, 4, "score")


@query
def global_counts(spark, sf):
    return counts.global_counts(_counts(spark, sf))


@query
def max_adj_count(spark, sf):
    names = [(t.replace("_", " "),) for t in LEX.terms]
    return counts.max_counts(_counts(spark, sf), local_frame(spark, names, ("grp",)))


@query
def vocab_size(spark, sf):
    return counts.vocabulary_sizes(_counts(spark, sf))


@query
def group_counters(spark, sf):
    """Counter maps in eight shards, shown as sorted ``term:count`` lists."""
    maps = counts.counter_maps(_counts(spark, sf), shards=8)
    shown = F.transform(
        F.array_sort(F.map_entries("counter")),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
    )
    return maps.select("grp", "pos", "shard", F.array_join(shown, " ").alias("counter"))


@query
def taxonomy_join(spark, sf):
    joined = counts.with_taxonomy(_counts(spark, sf), taxonomy_frame(spark))
    return joined.select("grp", "category", "region", "pos", "term", "cnt")


# --- log-odds --------------------------------------------------------------


@query
def weighted_log_odds(spark, sf):
    return _rounded(_scores(spark, sf), 4, "score")


@query
def rest_log_odds(spark, sf):
    """Against the other groups only."""
    scored = logodds.weighted_log_odds(settle(_counts(spark, sf)), background="rest", poses=POSES)
    return _rounded(scored, 4, "score")


@query
def top_log_odds(spark, sf):
    return _rounded(_top(spark, sf), 4, "score")


@query
def top5_combined(spark, sf):
    return logodds.joint_top(_scores(spark, sf))


def _word_counts(docs: DataFrame) -> DataFrame:
    words = sentences.tokenize(docs).select(F.explode("tokens").alias("term"))
    return (
        words.groupBy("term")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(rules.word_class(F.col("term")).alias("pos"), "term", "cnt")
    )


@query
def two_corpus_log_odds(spark, sf):
    pairs = settle(
        logodds.corpus_pairs(_word_counts(_docs(spark, sf)), _word_counts(_turns(spark, sf)))
    )
    return _rounded(logodds.both_ends(logodds.two_sided_log_odds(pairs), 25), 4, "score")


@query
def groups_vs_rest(spark, sf):
    pairs = settle(logodds.target_pairs(settle(_counts(spark, sf)), TARGETS))
    return _rounded(logodds.both_ends(logodds.two_sided_log_odds(pairs), 10), 4, "score")


# --- similarity ------------------------------------------------------------


def _label_means(spark, sf) -> DataFrame:
    """Settled, so that the join with the embeddings is planned from its real size."""
    emb = _table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    return settle(mean_pool(emb, ["label"], "vector"))


@query
def mean_pool_vectors(spark, sf):
    """Mean vector per label, one row per dimension."""
    pooled = _label_means(spark, sf)
    out = pooled.select(
        F.col("label").cast("bigint").alias("label"), F.posexplode("vector").alias("dim", "value")
    )
    return out.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


QUERIES["mean_pool"] = QUERIES.pop("mean_pool_vectors")


@query
def cosine_pairs(spark, sf):
    """Each vector against the mean of its label."""
    emb = _table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    sims = similarity.cosine_to(emb, _label_means(spark, sf), "label")
    return sims.select("vec_id", F.col("label").cast("bigint").alias("label"), F.round("cosine_sim", 6).alias("cosine_sim"))


@query
def term_category_sim(spark, sf):
    return _rounded(_similarities(spark, sf), 6, "cosine_sim")


@query
def pseudo_docs(spark, sf):
    """Documents of groups and of categories."""
    docs = similarity.group_documents(settle(_top(spark, sf, SIMILARITY_MIN_COUNT)))
    categories = similarity.category_documents(docs, _members(spark))
    return docs.select(F.lit("group").alias("kind"), F.col("grp").alias("name"), "pos", "text").unionByName(
        categories.select(F.lit("category").alias("kind"), F.col("category").alias("name"), "pos", "text")
    )


@query
def category_contrast_vals(spark, sf):
    return _rounded(_contrast(spark, sf), 6, "cosine_sim")


# --- statistics ------------------------------------------------------------


@query
def category_contrast_stats(spark, sf):
    out = stats.category_contrast_stats(_contrast(spark, sf))
    return _rounded(_rounded(out, 6, "mean_own", "mean_other", "p_value"), 4, "t_stat")


@query
def alignment_contrast(spark, sf):
    out = stats.alignment_contrast(_contrast(spark, sf))
    return _rounded(_rounded(out, 6, "sim_own", "sim_other", "diff", "p_value"), 4, "t_stat")


@query
def group_sim_agg(spark, sf):
    return _rounded(_summary(spark, sf), 6, "mean_sim", "sd_sim")


@query
def group_order(spark, sf):
    return _rounded(stats.group_order(_regional(spark, sf)), 6, "mean_sim")


@query
def region_stats(spark, sf):
    return _rounded(stats.region_stats(_regional(spark, sf)), 6, "p")


@query
def region_group_stats(spark, sf):
    return _rounded(stats.region_group_stats(_summary(spark, sf)), 6, "p")


@query
def global_group_stats(spark, sf):
    return _rounded(stats.global_group_stats(_summary(spark, sf)), 6, "p")


@query
def label_stats(spark, sf):
    """The region test over all embeddings: labels as regions, cosines to the label mean."""
    emb = _table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    sims = similarity.cosine_to(emb, _label_means(spark, sf), "label")
    regional = sims.select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("region"),
        F.lit("adj").alias("pos"),
        "cosine_sim",
    )
    return _rounded(stats.region_stats(regional), 6, "p")


def _boxes(df: DataFrame, keys: list[str]) -> DataFrame:
    return _rounded(
        stats.boxplot_table(df, keys), 6, "q1", "median", "q3", "whisker_low", "whisker_high"
    )


@query
def boxplot_stats(spark, sf):
    """Box-plot numbers of similarities by category and pos."""
    return _boxes(_similarities(spark, sf), ["category", "pos"])


@query
def boxplot_labels(spark, sf):
    """Box-plot numbers of all embeddings' cosines to their label mean."""
    emb = _table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    sims = similarity.cosine_to(emb, _label_means(spark, sf), "label")
    return _boxes(sims.select(F.col("label").cast("bigint").alias("label"), "cosine_sim"), ["label"])
