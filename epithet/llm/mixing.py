"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

A source's documents lie in hash order, which is their random permutation; 65,536 slots of that
order form 256 blocks.  A source gives whole passes of its blocks and then the first slots of one
more pass, up to its target.  A tree splits these exact block quotas among the output shards: at
each node the left half draws its blocks of every source without replacement.  The shards take
disjoint runs of a second permutation of the blocks and shuffle their rows locally.

Only DataFrame operations; what leaves a source is one row for each block or shard, never a row
for each document in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epithet.llm.common import WORD, let, stage, text_or_empty

BLOCK_BITS, SLOT_BITS = 8, 16
BLOCKS = 1 << BLOCK_BITS
SEED = 20_011


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _slot(size: Column) -> Column:
    """Place of a row in its source's permutation, 0 to 65,535."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), size), 64 - SLOT_BITS)


def source_targets(
    totals: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn.  The targets add up to ``share`` of
    all words; none is above ``most`` times its source, the excess going to the others by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    full_first = everything.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1)
    shared = (
        ranked.withColumn("w", F.array(*map(F.lit, map(float, weights)))[F.col("place") % len(weights)])
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("w"))
    )
    before = lambda c: F.coalesce(F.sum(c).over(full_first), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - before("cap")) / (
        F.sum("w").over(everything) - before("w")
    )
    leveled = shared.withColumn("level", level).withColumn(
        "first_open", F.min(F.when(F.col("fill") > F.col("level"), F.col("fill"))).over(everything)
    )
    final = F.max(F.when(F.col("fill") == F.col("first_open"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap")))
    return leveled.select("source", "source_size", "place", target.alias("target"))


def _quotas(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole passes, the last slot of the partial pass (-1: none), blocks drawn."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    asked = targets.withColumn("passes", passes.cast("int")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    keyed = slots.withColumn("block", F.shiftright("slot", SLOT_BITS - BLOCK_BITS))
    same = lambda other: F.col("s.source").eqNullSafe(other)
    running = Window.partitionBy("source").orderBy("block")
    blocks = (
        keyed.groupBy("source", "block")
        .agg(F.sum("words").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
    )
    edge = (
        blocks.alias("s")
        .join(asked.alias("t"), same(F.col("t.source")))
        .where((F.col("rest") > 0) & (F.col("upto") - F.col("words") < F.col("rest")))
        .groupBy("s.source", "rest")
        .agg(F.max_by(F.struct("block", (F.col("upto") - F.col("words")).alias("base")), "block").alias("e"))
        .select("source", "rest", "e.*")
    )
    inside = (
        keyed.alias("s")
        .join(edge.alias("e"), same(F.col("e.source")) & (F.col("s.block") == F.col("e.block")))
        .select("s.source", "slot", "words", "rest", "base")
        .withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("slot")))
    )
    first = edge.select("source", (F.col("block") * (1 << (SLOT_BITS - BLOCK_BITS)) - 1).alias("slot"),
                        F.abs(F.col("base") - F.col("rest")).alias("miss"))
    ends = inside.select("source", "slot", F.abs(F.col("upto") - F.col("rest")).alias("miss")).union(first)
    cuts = ends.groupBy("source").agg(F.min(F.struct("miss", "slot"))["slot"].cast("int").alias("cut"))
    joined = asked.alias("s").join(cuts.alias("c"), same(F.col("c.source")), "left")
    cut = F.coalesce("cut", F.lit(-1))
    drawn = F.col("passes") * BLOCKS + F.when(
        cut >= 0, F.shiftright(cut, SLOT_BITS - BLOCK_BITS) + 1
    ).otherwise(0)
    return joined.select(
        "s.source", "source_size", "place", "target", "passes", cut.alias("cut"), drawn.cast("long").alias("drawn")
    )


def _left_half(node: Column, quotas: Column) -> Column:
    """How many blocks of each source go left: draws without replacement, source after source."""

    def draws(left: Column, slots: Column, source: Column, quota: Column) -> Column:
        chance = lambda j: F.pmod(F.xxhash64(F.lit(SEED), node, source, j), F.lit(1 << 53)) / float(1 << 53)
        steps = F.filter(F.sequence(F.lit(0).cast("long"), quota), lambda j: j < quota)
        return F.aggregate(
            steps,
            F.lit(0).cast("long"),
            lambda got, j: got + (chance(j) * (left - j) < (slots - got)).cast("long"),
        )

    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(
        total.alias("left"),
        F.floor(total / 2).alias("slots"),
        F.array().cast("array<bigint>").alias("out"),
    )
    return F.aggregate(
        quotas,
        start,
        lambda a, q: let(
            draws(a["left"], a["slots"], F.size(a["out"]), q),
            lambda got: F.struct(
                (a["left"] - q).alias("left"),
                (a["slots"] - got).alias("slots"),
                F.array_append(a["out"], got).alias("out"),
            ),
        ),
    )["out"]


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """(shard, quotas): the root's exact block quotas among ``2 ** levels`` shards."""
    rows = F.array_sort(F.collect_list(F.struct("place", "drawn")))
    tree = quotas.agg(F.transform(rows, lambda r: r["drawn"]).alias("quotas")).select(
        F.lit(1).cast("long").alias("node"), "quotas"
    )
    for _ in range(levels):
        left = _left_half(F.col("node"), F.col("quotas"))
        halves = let(
            left,
            lambda half: F.array(
                F.struct((F.col("node") * 2).alias("node"), half.alias("quotas")),
                F.struct(
                    (F.col("node") * 2 + 1).alias("node"),
                    F.zip_with(F.col("quotas"), half, lambda q, x: q - x).alias("quotas"),
                ),
            ),
        )
        tree = tree.select(F.explode(halves).alias("n")).select("n.*")
    return tree.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), "quotas")


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    levels: int = 6,
) -> DataFrame:
    """One row per source: targets, passes, the cut of the partial pass, and each block's shard."""
    sized = docs.select("source", "doc_id", _size().alias("size"))
    slots = stage(
        sized.groupBy("source", _slot(F.col("size")).alias("slot")).agg(F.sum("size").alias("words")), "mix-slots"
    )
    totals = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    quotas = stage(_quotas(slots, source_targets(totals, weights, share, most)), "mix-quotas")
    leaves = split_quotas(quotas, levels).select("shard", F.posexplode("quotas").alias("place", "quota"))
    runs = leaves.groupBy("place").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("shard", "quota"))),
                lambda r: F.array_repeat(r["shard"], r["quota"].cast("int")),
            )
        ).alias("run")
    )
    draw_order = F.array_sort(
        F.transform(
            F.col("run"), lambda _, i: F.struct(F.xxhash64(F.lit(SEED), "place", i).alias("key"), i.alias("item"))
        )
    )
    shards = F.transform(
        F.array_sort(
            F.transform(draw_order, lambda o, i: F.struct(o["item"].alias("item"), F.get("run", i).alias("shard")))
        ),
        lambda o: o["shard"],
    )
    return stage(quotas.join(runs, "place").withColumn("shards", shards).drop("run"), "mix-plan")


ADDED = ("size", "source_size", "target", "copies")


def _drawn(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` and a struct ``__mix`` of the four that ``draw`` adds."""
    plan = mixing_plan(docs, **options)
    packed = plan.select(F.struct(*plan.columns).alias("__plan"))
    sized = docs.select("*", _size().alias("__size")).select("*", _slot(F.col("__size")).alias("__slot"))
    p = F.col("__plan")
    block = F.shiftright("__slot", SLOT_BITS - BLOCK_BITS).cast("int")
    whole = F.filter(F.sequence(F.lit(0), p["passes"]), lambda n: n < p["passes"])
    part = F.when(F.col("__slot") <= p["cut"], F.array(p["passes"])).otherwise(F.array().cast("array<int>"))
    copies = F.transform(
        F.concat(whole, part),
        lambda n: F.struct(n.alias("pass"), F.get(p["shards"], n * BLOCKS + block).alias("shard")),
    )
    added = F.struct(
        F.col("__size").alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies")
    )
    joined = sized.join(packed, F.col("source").eqNullSafe(p["source"]))
    return joined.select(*[joined[c] for c in docs.columns], added.alias("__mix"))


def draw(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` lists (pass, shard) for each time the mix takes the row, at most ``most`` times.
    Sources are the values of ``source``, null among them; a null text has size 0.  Rows of one id
    and size share a slot and are taken together, so repeated rows are all kept or all left.  An
    empty table gives an empty mix.  Input that has a column of one of these four names is an error.
    """
    if clash := sorted(set(ADDED) & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns {clash} would be overwritten")
    return _drawn(docs, **options).select(*docs.columns, "__mix.*")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: columns of ``docs``, whatever their names, one row for each copy, by shard and
    shuffled locally."""
    drawn = _drawn(docs, **options).select(*docs.columns, F.explode("__mix.copies").alias("__copy"))
    order = F.xxhash64(F.lit(SEED + 1), "__copy", "doc_id", "text")
    return (
        drawn.withColumns({"__shard": F.col("__copy.shard"), "__order": order})
        .repartition("__shard", F.pmod("__order", F.lit(64)))
        .sortWithinPartitions("__shard", "__order")
        .select(*docs.columns)
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    drawn = draw(docs.select("doc_id", "source", "text"))
    taken = (F.col("size") * F.size("copies")).cast("long").alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken)
