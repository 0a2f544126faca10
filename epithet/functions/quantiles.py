"""Exact quantiles per key without gathering a key in one task.

``percentile`` keeps every distinct value of a key in one aggregation buffer.  Here each wanted rank has
a range of values that holds it, at first all of the key's.  While a range holds many distinct values, a
sketch of fixed size cuts it into buckets, bucket totals tell which one holds the rank, and that bucket is
the next range.  Only ranges of few values are ranked.  Sketches decide how many rounds it takes, never the
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epithet.plans.stages import settle

BUCKETS = 128
FEW = 4096  # distinct values of a range that one window may rank
SALTS = 32


def _meet(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the entries that ``few`` (some per key) has for their key.

    A key of any share of the rows is spread: its rows are salted by value, its entries repeated.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    same = F.col("r._salt") == F.col("f._salt")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    others = [F.col(f"f.{c}") for c in few.columns if c not in keys]
    return salted.alias("r").join(copies.alias("f"), same).select("r.*", *others).drop("_salt")


def _within(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that lie in a range (lo, hi] of their key; a null bound is open."""
    v = F.col("_v")
    met = _meet(rows, ranges.select(*keys, "_lo", "_hi").distinct(), keys)
    return met.where((F.col("_lo").isNull() | (v > F.col("_lo"))) & (F.col("_hi").isNull() | (v <= F.col("_hi"))))


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The ranges cut down to the bucket that holds their rank."""
    inside = settle(_within(rows, ranges, keys))
    range_key = [*keys, "_lo", "_hi"]
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketches = inside.groupBy(*range_key).agg(F.percentile_approx("_v", cuts, buckets * 20).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = _meet(inside.withColumnsRenamed({"_lo": "_a", "_hi": "_z"}), sketches, keys).where(
        F.col("_a").eqNullSafe(F.col("_lo")) & F.col("_z").eqNullSafe(F.col("_hi"))
    )
    totals = placed.groupBy(*range_key, bucket.alias("_b")).agg(
        F.sum("_c").alias("_bc"), F.count("*").alias("_distinct"), F.max("_v").alias("_top")
    )
    # At most ``buckets`` rows a range.
    before = Window.partitionBy(*range_key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ordered = totals.withColumns(
        {"_before": F.coalesce(F.sum("_bc").over(before), F.lit(0)), "_under": F.max("_top").over(before)}
    )
    held = ordered.withColumnsRenamed({"_lo": "_a", "_hi": "_z", "_distinct": "_d"})
    same = F.col("r._lo").eqNullSafe(F.col("h._a")) & F.col("r._hi").eqNullSafe(F.col("h._z"))
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
    start = F.col("r._start") + F.col("h._before")
    hit = F.col("r._rank").between(start, start + F.col("h._bc") - 1)
    return settle(
        ranges.alias("r")
        .join(held.alias("h"), same & hit)
        .select(
            *[F.col(f"r.{k}").alias(k) for k in keys],
            "r._rank",
            start.alias("_start"),
            F.coalesce("h._under", "r._lo").alias("_lo"),
            F.col("h._top").alias("_hi"),
            F.col("h._d").alias("_distinct"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    buckets: int = BUCKETS,
    few: int = FEW,
) -> DataFrame:
    """One row per key: the linearly interpolated quantiles named in ``probs`` and ``n``.

    Nulls are ignored.
    """
    keys = list(keys)
    rows = settle(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    totals = rows.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count("*").alias("_distinct"))
    rank = {name: (F.col("n") - 1) * F.lit(p) for name, p in probs.items()}
    wanted = F.array_distinct(F.array(*[f(r).cast("bigint") for r in rank.values() for f in (F.floor, F.ceil)]))
    double = F.lit(None).cast("double")
    ranges = settle(
        totals.select(*keys, F.explode(wanted).alias("_rank"), F.lit(0).cast("bigint").alias("_start"),
                      double.alias("_lo"), double.alias("_hi"), "_distinct")
    )
    while not (many := ranges.where(F.col("_distinct") > few)).isEmpty():
        ranges = settle(ranges.where(F.col("_distinct") <= few).union(_narrowed(rows, many, keys, buckets)))

    range_key = [*keys, "_lo", "_hi"]
    up_to = Window.partitionBy(*range_key).orderBy("_v")
    ranked = (
        _within(rows, ranges, keys)
        .withColumn("_end", F.sum("_c").over(up_to))
        .groupBy(*range_key)
        .agg(F.sort_array(F.collect_list(F.struct("_end", "_v"))).alias("_steps"))
    )
    same = F.col("r._lo").eqNullSafe(F.col("s._lo")) & F.col("r._hi").eqNullSafe(F.col("s._hi"))
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    place = F.col("r._rank") - F.col("r._start")
    at = F.get(F.filter("s._steps", lambda s: s["_end"] > place), 0)["_v"]
    found = ranges.alias("r").join(ranked.alias("s"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._rank", at.alias("_at"))
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_values"))

    def value_at(r: Column) -> Column:
        return F.element_at("v._values", r.cast("bigint"))

    def quantile(r: Column) -> Column:
        low = value_at(F.floor(r))
        return low + (value_at(F.ceil(r)) - low) * (r - F.floor(r))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"v.{k}"))
    return totals.alias("t").join(by_rank.alias("v"), same).select(
        *[F.col(f"t.{k}").alias(k) for k in keys], "n", *[quantile(r).alias(name) for name, r in rank.items()]
    )
