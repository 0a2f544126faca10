"""Log-odds scores of terms, and the tables cut from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epithet.functions.quantiles import exact_quantiles
from epithet.plans.stages import settle

PRIOR = 0.01
MIN_COUNT = 5
TOP_TERMS = 50
SCORED_POS = ("adj", "verb")


def _logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def group_totals(counts: DataFrame) -> DataFrame:
    """Total count per (group, pos) and per pos: one row per group and word class."""
    per_group = counts.groupBy("grp", "pos").agg(F.sum("cnt").alias("n"))
    return per_group.withColumn("n_all", F.sum("n").over(Window.partitionBy("pos")))


def weighted_log_odds(
    counts: DataFrame,
    alpha: float = PRIOR,
    min_count: int = MIN_COUNT,
    background: str = "all",
    poses: Sequence[str] = SCORED_POS,
) -> DataFrame:
    """(grp, pos, term, cnt, score): log-odds with an informative Dirichlet prior.

    The prior is proportional to the background counts.  ``background`` is all groups
    including the scored one, or the ``rest``.  A term that is the whole vocabulary
    has no finite log-odds and gets a null score.

    The per-term background is a window over (pos, term), at most one row per group.
    Totals have one row per (group, pos); the optimizer picks the join by their size.
    """
    if background not in ("all", "rest"):
        raise ValueError(f"background must be 'all' or 'rest', not {background!r}")
    counts = counts.where(F.col("pos").isin(*poses))
    everywhere = F.sum("cnt").over(Window.partitionBy("pos", "term"))
    rows = counts.withColumn("g_all", everywhere).where(F.col("cnt") >= min_count)
    rows = rows.join(group_totals(counts), ["grp", "pos"])
    c, n = F.col("cnt"), F.col("n")
    own = 0 if background == "all" else 1
    g = F.col("g_all") - own * c
    n_bg = F.col("n_all") - own * n
    prior, prior_total = alpha * g, alpha * n_bg
    p = (c + prior) / (n + prior_total)
    q = (g + prior) / (n_bg + prior_total)
    variance = 1 / (c + prior) + F.when(g > 0, 1 / (g + prior))
    score = (_logit(p) - _logit(q)) / F.sqrt(variance)
    return rows.select("grp", "pos", "term", "cnt", score.alias("score"))


def score_gate(scores: DataFrame) -> DataFrame:
    """Median of the positive scores per (group, pos)."""
    positive = scores.where(F.col("score") > 0)
    return exact_quantiles(positive, ["grp", "pos"], "score", {"gate": 0.5}).select(
        "grp", "pos", "gate"
    )


def top_terms(scores: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """Terms at or above the median positive score (0 if none is positive), best ``k``.

    The rank limit is applied per task before the shuffle (window group limit).
    """
    gated = scores.join(score_gate(scores), ["grp", "pos"], "left").where(
        F.col("score") >= F.coalesce("gate", F.lit(0.0))
    )
    order = Window.partitionBy("grp", "pos").orderBy(F.desc("score"), "term")
    ranked = gated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(
        "grp", "pos", "term", "cnt", "score", F.col("rank").cast("bigint").alias("rank")
    )


def joint_top(scores: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` terms of a group over all word classes, as joined strings."""
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "pos", "term")
    best = (
        scores.where(F.col("score").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", "term", "pos", "score")))
    listed = best.groupBy("grp").agg(rows.alias("rows"))
    return listed.select(
        "grp",
        F.array_join(F.transform("rows", lambda r: r["term"]), ", ").alias("top_terms"),
        F.array_join(F.transform("rows", lambda r: r["pos"]), ", ").alias("top_pos"),
        F.array_join(
            F.transform("rows", lambda r: F.format_string("%.3f", r["score"])), ", "
        ).alias("top_scores"),
    )


def two_sided_log_odds(pairs: DataFrame, alpha: float = PRIOR) -> DataFrame:
    """Scores of (pos, term, c1, c2): flat prior over the joint vocabulary of each pos.

    Totals have one row per pos.  They are settled, so that the join is planned from their real size:
    guessed from that of the pairs, it would deal the whole vocabulary out by pos, a few tasks in all.
    """
    totals = settle(
        pairs.groupBy("pos").agg(
            F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.count(F.lit(1)).alias("v")
        )
    )
    rows = pairs.join(totals, "pos")
    mass = alpha * F.col("v")

    def log_ratio(c: str, n: str) -> Column:
        return F.log((F.col(c) + alpha) / (F.col(n) + mass - F.col(c) - alpha))

    variance = 1 / (F.col("c1") + alpha) + 1 / (F.col("c2") + alpha)
    score = (log_ratio("c1", "n1") - log_ratio("c2", "n2")) / F.sqrt(variance)
    return rows.select("pos", "term", "c1", "c2", score.alias("score"))


def both_ends(scores: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most typical terms of either side per pos."""

    def end(side: int, order: Column) -> DataFrame:
        by = Window.partitionBy("pos").orderBy(order, "term")
        ranked = scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return ranked.select(
            F.lit(side).cast("bigint").alias("side"),
            "pos",
            F.col("rank").cast("bigint").alias("rank"),
            "term",
            "c1",
            "c2",
            "score",
        )

    return end(1, F.desc("score")).unionByName(end(2, F.asc("score")))


def corpus_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pos, term, c1, c2) of two count tables (pos, term, cnt)."""
    one = first.select("pos", "term", F.col("cnt").alias("c1"), F.lit(0).cast("bigint").alias("c2"))
    two = second.select("pos", "term", F.lit(0).cast("bigint").alias("c1"), F.col("cnt").alias("c2"))
    return (
        one.unionByName(two)
        .groupBy("pos", "term")
        .agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    )


def target_pairs(counts: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(pos, term, c1, c2): pooled target groups against all other groups.

    A target that no row of ``counts`` names is an error; a pos in which a target has no counts yields
    no rows.
    """
    targets = sorted(set(targets))
    found = {r[0] for r in counts.where(F.col("grp").isin(targets)).select("grp").distinct().collect()}
    if missing := sorted(set(targets) - found):
        raise ValueError(f"no counts of {', '.join(missing)}")
    is_target = F.col("grp").isin(targets)
    present = (
        counts.where(is_target)
        .select("pos", "grp")
        .distinct()
        .groupBy("pos")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == len(targets))
        .select("pos")
    )
    pairs = counts.groupBy("pos", "term").agg(
        F.sum(F.when(is_target, F.col("cnt")).otherwise(0)).alias("c1"),
        F.sum(F.when(is_target, 0).otherwise(F.col("cnt"))).alias("c2"),
    )
    return pairs.join(present, "pos", "left_semi")
