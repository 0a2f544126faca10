"""Acceptance of masked windows by a text classifier: a table of weights, applied by a join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a job needs of a model: windows in, the same rows with ``prediction`` out.
Classifier = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class NgramModel:
    """A linear model over unigrams and bigrams: (gram, weight), and a bias; above 0 is accepted."""

    weights: DataFrame
    bias: float

    def __call__(self, windows: DataFrame) -> DataFrame:
        return classify_windows(windows, self)


def grams(text: Column) -> Column:
    """Words and pairs of neighbouring words of a window, each as often as it occurs."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat_ws(" ", F.get(words, i), w),
    )
    return F.concat(words, pairs)


def fit_windows(labelled: DataFrame, text: str = "window_text", label: str = "label") -> NgramModel:
    """Multinomial naive Bayes with add-one smoothing over all labelled windows (labels 0 and 1).

    Each gram's weight is the log of its smoothed share among accepted windows less that among the
    others.  Counts are aggregated by gram, so no class is gathered.
    """
    rows = labelled.where(F.col(label).isin(0, 1))
    good = F.col(label).cast("bigint")
    counts = (
        rows.select(F.explode(grams(F.col(text))).alias("gram"), good.alias("y"))
        .groupBy("gram")
        .agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    )
    n1, n0, v = counts.agg(F.sum("c1"), F.sum("c0"), F.count(F.lit(1))).first()
    d1, d0 = rows.agg(F.sum(good), F.sum(1 - good)).first()
    if not d1 or not d0:
        raise ValueError("both labels are needed")
    share = lambda c, n: F.log((F.col(c) + 1) / F.lit(float(n + v)))
    prior = rows.sparkSession.range(1).select(F.log(F.lit(d1 / d0))).first()[0]
    return NgramModel(counts.select("gram", (share("c1", n1) - share("c0", n0)).alias("weight")), prior)


def classify_windows(windows: DataFrame, model: NgramModel, text: str = "window_text") -> DataFrame:
    """Adds ``prediction`` (1 = accepted).

    Grams of each distinct window text meet the weights in a join and are summed; grams without a
    weight add nothing.
    """
    texts = windows.select(text).where(F.col(text).isNotNull()).distinct()
    sums = (
        texts.select(text, F.explode_outer(grams(F.col(text))).alias("gram"))
        .join(model.weights, "gram", "left")
        .groupBy(text)
        .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_sum"))
    )
    # Rounded, so that the order of the summands can't turn a tie.
    verdict = (F.round(F.col("_sum") + F.lit(model.bias), 9) > 0).cast("bigint")
    scored = sums.select(F.col(text).alias("_text"), verdict.alias("prediction"))
    joined = windows.join(scored, F.col(text) == F.col("_text"), "left").drop("_text")
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit(0).cast("bigint")))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("prediction = 1").drop("prediction")


def classify_by_rule(windows: DataFrame, rule: Column) -> DataFrame:
    """A condition in place of a model."""
    return windows.withColumn("prediction", rule.cast("bigint"))


def pass_counts(classified: DataFrame) -> DataFrame:
    """Mentions per group before and after the classifier."""
    return classified.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.col("prediction") == 1).alias("n_accepted")
    )
