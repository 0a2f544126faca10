"""Summaries and tests over similarity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epithet.functions.quantiles import exact_quantiles
from epithet.functions.student_t import log_p_value, p_text
from epithet.plans.stages import settle

NAN = float("nan")


def _one_sample(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd (n - 1), standard error and t against zero, per key; nulls ignored."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    se = F.col("sd") / F.sqrt("n")
    return stats.withColumn("se", se).withColumn("t", _ratio(F.col("mean"), se))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def with_p(df: DataFrame, t: str = "t", n: str = "n") -> DataFrame:
    """Two-sided p of a t statistic with n - 1 degrees of freedom, and its log."""
    logged = df.withColumn("log_p", log_p_value(F.col(t), F.col(n) - 1))
    return logged.withColumn("p", F.exp("log_p"))


def attach_region(sims: DataFrame, taxonomy: DataFrame, category: str) -> DataFrame:
    """Similarities of one category with the group's region (null where it has none)."""
    regions = taxonomy.select(F.col("term").alias("grp"), "region")
    return (
        sims.where(F.col("category") == category)
        .withColumn("pos", F.lower("pos"))
        .join(regions, "grp", "left")
    )


def group_summary(regional: DataFrame) -> DataFrame:
    """Mean, sample sd and number of terms per (group, region, pos); no region, no row."""
    return (
        regional.where(F.col("region").isNotNull())
        .groupBy("grp", "region", "pos")
        .agg(
            F.avg("cosine_sim").alias("mean_sim"),
            F.stddev_samp("cosine_sim").alias("sd_sim"),
            F.count("cosine_sim").alias("n_terms"),
        )
    )


def group_order(sims: DataFrame) -> DataFrame:
    """Groups by descending mean similarity within a pos, with their place (ties by name)."""
    means = sims.groupBy("pos", "grp").agg(F.avg("cosine_sim").alias("mean_sim"))
    place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("mean_sim"), "grp"))
    return means.withColumn("place", place.cast("bigint"))


def _report(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_p(stats).select(
        *keys,
        F.round("mean", 4).alias("b"),
        F.round("se", 4).alias("se"),
        F.round("t", 2).alias("t"),
        F.col("p"),
        p_text(F.col("log_p")).alias("p_text"),
        F.round("d", 3).alias("d"),
        "n",
    )


def region_stats(regional: DataFrame) -> DataFrame:
    """Pooled one-sample test per (region, pos) over term similarities."""
    stats = _one_sample(regional.where(F.col("region").isNotNull()), ["region", "pos"], "cosine_sim")
    return _report(stats.withColumn("d", _ratio(F.col("mean"), F.col("sd"))), ["region", "pos"])


def region_group_stats(summary: DataFrame) -> DataFrame:
    """One-sample test per (region, pos) over group means; regions with one group skipped."""
    stats = _one_sample(summary, ["region", "pos"], "mean_sim").where(F.col("n") >= 2)
    d = F.when(F.col("sd") == 0, F.lit(NAN)).otherwise(F.col("mean") / F.col("sd"))
    return _report(stats.withColumn("d", d), ["region", "pos"])


def global_group_stats(summary: DataFrame) -> DataFrame:
    """One-sample test per pos over group means."""
    stats = _one_sample(summary, ["pos"], "mean_sim")
    return _report(stats.withColumn("d", _ratio(F.col("mean"), F.col("sd"))), ["pos"])


def category_contrast_stats(contrast: DataFrame) -> DataFrame:
    """Own similarity against the others', paired, per (group, pos).

    With one own value this is a one-sample test of own minus other.  Rows need both
    kinds; t and p are null for a single other category.
    """
    own = F.col("category_type") == "own"
    other = F.when(~own, F.col("cosine_sim"))
    stats = contrast.groupBy("grp", "pos").agg(
        F.avg(F.when(own, F.col("cosine_sim"))).alias("mean_own"),
        F.avg(other).alias("mean_other"),
        F.stddev_samp(other).alias("sd"),
        F.count(other).alias("n_other"),
    )
    stats = stats.where(F.col("mean_own").isNotNull() & (F.col("n_other") > 0))
    t = _ratio(F.col("mean_own") - F.col("mean_other"), F.col("sd") / F.sqrt("n_other"))
    return with_p(stats.withColumn("t_stat", t), "t_stat", "n_other").select(
        "grp", "pos", "mean_own", "mean_other", "t_stat", F.col("p").alias("p_value"), "n_other"
    )


def alignment_contrast(contrast: DataFrame) -> DataFrame:
    """Own minus mean other similarity per group, tested over the groups of a pos.

    The test has one row per pos and is attached to every row of it.
    """
    own = F.col("category_type") == "own"
    diffs = settle(
        contrast.groupBy("grp", "pos")
        .agg(
            F.max(F.when(own, F.col("category"))).alias("own_category"),
            F.avg(F.when(own, F.col("cosine_sim"))).alias("sim_own"),
            F.avg(F.when(~own, F.col("cosine_sim"))).alias("sim_other"),
        )
        .where(F.col("sim_own").isNotNull() & F.col("sim_other").isNotNull())
        .withColumn("diff", F.col("sim_own") - F.col("sim_other"))
    )
    test = with_p(_one_sample(diffs, ["pos"], "diff")).select(
        "pos", F.col("t").alias("t_stat"), F.col("p").alias("p_value"), "n"
    )
    return diffs.join(test, "pos").select(
        "grp", "own_category", "pos", "sim_own", "sim_other", "diff", "t_stat", "p_value", "n"
    )


def boxplot_table(df: DataFrame, keys: Sequence[str], value: str = "cosine_sim") -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and outliers per key; the values are settled."""
    df = settle(df.select(*keys, value))
    quartiles = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = df.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    edges = rows.join(quartiles, list(keys)).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return quartiles.join(edges, list(keys)).select(
        *keys, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"
    )
