"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Equal n-gram sets form one class, and classes are the rows of the matrix.  A column's entries are
only needed for the rows that hold it among their first, rarest n-grams: two rows that link must
share one there, or their overlap can't reach the bound that follows from their sizes.  The product
runs in two rounds.  First each row meets the most central row of its columns, which joins the
copies of a text without pairing them with each other.  Then rows of a shared column that are still
in different components meet, block by block.  Overlaps are counted over the whole n-gram sets.

Column frequencies come from a sketch of fixed size over all documents.  They decide the order of
the n-grams and so the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epithet.llm.common import Shared, in_slices, mix, shingle_set, stage

SHINGLE = 5
# Two sets link when PER * overlap >= SHARE * union.
SHARE, PER = 80, 100
SKETCH_BITS = 20  # 4 bytes each in every task; more bits keep apart more columns
SKETCH_BLOCK = 1 << 14
HOT = 4096  # columns above this many entries are salted
FILTER_BITS = 1 << 25
BLOCK_ROWS = 256
BLOCK_GRAMS = 1 << 21
BLOCK_PAIRS = 20_000
BAND = 0.05  # sizes of a band differ by about as much, as a share


def set_key(grams: np.ndarray) -> int:
    """One number for a set of n-grams; equal sets have equal keys."""
    total = int(mix(grams).sum(dtype=np.uint64)) + len(grams) * 0xD6E8FEB86659FD93
    return int(mix(np.array([total % (1 << 64)], np.uint64)).view(np.int64)[0])


def _scan_sets(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, key) of each document; (block, counts) of each task's sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        low = np.uint64((1 << SKETCH_BITS) - 1)
        ids = None

        def rows(ids: pa.Array, n: list, keys: list, block: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(block, pa.int32()),
                    pa.array(counts, pa.binary()),
                ],
                ["doc_id", "n", "key", "block", "counts"],
            )

        for batch in in_slices(batches):
            ids, n, keys = batch["doc_id"], [], []
            for text in batch["text"]:
                grams = shingle_set((text.as_py() or "").encode(), SHINGLE)
                n.append(len(grams))
                keys.append(set_key(grams) if len(grams) else None)
                np.add.at(sketch, (grams & low).astype(np.int64), 1)
            yield rows(ids, n, keys, [None] * len(n), [None] * len(n))
        if ids is not None:
            parts = sketch.reshape(-1, SKETCH_BLOCK)
            held = [b for b in range(len(parts)) if parts[b].any()]
            none = [None] * len(held)
            yield rows(pa.nulls(len(held), ids.type), none, none, held, [parts[b].tobytes() for b in held])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n int, key bigint, block int, counts binary"
    )


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: 2 ** SKETCH_BITS numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint32)
                sums[block] = sums.get(block, 0) + part.astype(np.uint64)
        if sums:
            data = [s.tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["block", "counts"]
            )

    parts = scanned.where("block is not null").select("block", "counts")
    summed = parts.repartition("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint64).reshape(-1, SKETCH_BLOCK)
    for row in summed.collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.uint64)
    return np.minimum(out.ravel(), np.uint64(0xFFFFFFFF)).astype(np.uint32)


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """How many first n-grams a set of size n is filed under."""
    return n - -(-SHARE * n // PER) + 1


def _entries(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(gram, salted, key, n, place, central): each set under its rarest n-grams, once per task."""
    shared = Shared(docs.sparkSession, sketch)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        low = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in in_slices(batches):
            parts: list[tuple] = []
            for text in batch["text"]:
                grams = shingle_set((text.as_py() or "").encode(), SHINGLE)
                if not len(grams) or (key := set_key(grams)) in seen:
                    continue
                seen.add(key)
                n, often = len(grams), shared.value[(grams & low).astype(np.int64)]
                count = prefix_length(n)
                order = np.lexsort((grams, often))[:count]
                central = int(1000 * np.log2(often + 1.0).mean())
                parts.append((grams[order], often[order] > HOT, key, n, central))
            if parts:
                sizes = [len(p[0]) for p in parts]
                spread = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        pa.array(np.concatenate([p[1] for p in parts])),
                        pa.array(spread(2, np.int64)),
                        pa.array(spread(3, np.int32)),
                        pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                        pa.array(spread(4, np.int32)),
                    ],
                    ["gram", "hot", "key", "n", "place", "central"],
                )

    return docs.select("text").mapInArrow(
        file, "gram bigint, hot boolean, key bigint, n int, place int, central int"
    )


def _columns(entries: DataFrame) -> DataFrame:
    """Entries of the columns with two rows or more, with the column's size and most central row.

    A column of two rows is one pair: the row that is not central stands for it, if the two may link.  A
    hot column is dealt to 64 tasks; what each has found of it, one row, is put together after.
    """
    leader = F.max(F.struct("central", "key", "n", "place"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(0)
    dealt = entries.withColumn("salt", salt).repartition("gram", "salt").dropDuplicates(["gram", "salt", "key"])
    part = Window.partitionBy("gram", "salt")
    parts = dealt.withColumns({"size": F.count("*").over(part), "leader": leader.over(part)})
    other = F.col("leader")
    pair = (F.col("key") != other["key"]) & _may_link(F.col("n"), F.col("place"), other["n"], other["place"])
    found = stage(parts.where(F.col("hot") | (F.col("size") > 2) | ((F.col("size") == 2) & pair)), "join-columns")
    names = ("gram", "key", "n", "place", "central", "size", "leader")
    whole = (
        found.where("hot")
        .groupBy("gram", "salt")
        .agg(F.first("size").alias("size"), F.first("leader").alias("leader"))
        .groupBy("gram")
        .agg(F.sum("size").alias("size"), F.max("leader").alias("leader"))
        .where("size > 1")
    )
    hot = found.where("hot").drop("size", "leader").join(whole, "gram")
    return found.where("not hot").select(*names).union(hot.select(*names))


def _may_link(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """Bound from the sizes: what both sets still hold from this column on must reach the overlap."""
    most = F.least(n - place, other_n - other_place)
    return (SHARE + PER) * most >= SHARE * (n + other_n)


def _texts(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, text) of the wanted classes, one text each, and of few others.

    A bit filter of fixed size over the ids of their documents goes to the tasks.  Texts beyond those
    wanted do no harm: the join that follows doesn't ask for them.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    ids = classes.join(wanted, "key").select(bit.alias("bit"))
    word = F.shiftright("bit", 6).alias("word")
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    data = np.zeros(FILTER_BITS // 64, np.uint64)
    words = ids.groupBy(word).agg(F.bit_or(one).alias("bits")).toArrow()  # one row per 64 bits at most
    data[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = Shared(docs.sparkSession, data)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches):
            bits = batch["bit"].to_numpy()
            held = shared.value[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)
            keys, texts = [], []
            for i in np.flatnonzero(held).tolist():
                text = batch["text"][i].as_py() or ""
                grams = shingle_set(text.encode(), SHINGLE)
                if len(grams) and (key := set_key(grams)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["key", "text"])

    found = docs.select(bit.alias("bit"), "text").mapInArrow(read, "key bigint, text string")
    return found.groupBy("key").agg(F.first("text").alias("text"))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    The texts of all ``b`` of an ``a`` meet the text of ``a``, in as many salted blocks as the number of
    pairs asks for; texts take less room than their sets.  A run of one ``a`` is a block product.
    """
    pairs = stage(pairs, "join-pairs")
    salts = max(64, pairs.count() // BLOCK_PAIRS)
    placed = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    head = placed.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("row"), F.col("a").alias("key"))
    asked = head.union(placed.select("a", "salt", F.lit(1), "b"))
    wanted = stage(asked, "join-wanted")
    texts = _texts(docs, wanted.select("key").distinct(), classes)
    rows = wanted.join(texts, "key").repartition("a", "salt").sortWithinPartitions("a", "salt", "row")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, found, held = None, [], 0
        block: list[np.ndarray] = []
        names: list[tuple[int, int]] = []

        def close() -> None:
            if not block:
                return
            # Column by column: an entry of the block counts where the row has the same n-gram.
            sizes = np.array([len(x) for x in block])
            grams = np.concatenate(block)
            at = np.minimum(np.searchsorted(one, grams), len(one) - 1)
            overlap = np.add.reduceat((one[at] == grams).astype(np.int64), np.cumsum(sizes) - sizes)
            union = sizes + len(one) - overlap
            found.extend(names[i] for i in np.flatnonzero(PER * overlap >= SHARE * union).tolist())
            block.clear()
            names.clear()

        def links() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in in_slices(batches, BLOCK_ROWS):
            for a, row, key, text in zip(*(batch[c] for c in ("a", "row", "key", "text")), strict=True):
                if row.as_py() == 0:
                    close()
                grams = shingle_set(text.as_py().encode(), SHINGLE)
                if row.as_py() == 0:
                    one = grams
                else:
                    block.append(grams)
                    names.append((a.as_py(), key.as_py()))
                    held += len(grams)
                if held > BLOCK_GRAMS:
                    close()
                    held = 0
            close()
            held = 0
            yield links()

    linked = rows.select("a", "row", "key", "text").mapInArrow(multiply, "a bigint, b bigint")
    return stage(linked, "join-linked")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, label) of the nodes: the smallest label that links reach.  ``nodes`` has key and label.

    Each round takes the smallest label among the neighbours and then that label's own label, so
    chains shorten by half; labels are written after every round.
    """
    if links.isEmpty():
        return nodes
    both = stage(links.union(links.select("b", "a")).toDF("key", "other").distinct(), "join-links")
    labels = stage(nodes.join(both.select("key").distinct(), "key", "left_semi"), "join-labels")
    while True:
        near = (
            both.join(labels.select(F.col("key").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("key")
            .agg(F.min("near").alias("near"))
        )
        lowered = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("low"))
        jump = lowered.groupBy("label").agg(F.min("low").alias("jump"))
        # All nodes of a label follow it to the smallest that any of them has met.
        new = stage(
            lowered.join(jump, "label").select("key", F.col("jump").alias("label"), (F.col("jump") < F.col("label")).alias("moved")),
            "join-labels",
        )
        labels = new.select("key", "label")
        if new.where("moved").isEmpty():
            break
    rest = nodes.join(labels.select("key"), "key", "left_anti")
    return labels.union(rest)


def _reach(n: Column, place: Column) -> Column:
    """The largest set that a set of size ``n`` may link to through its n-gram at ``place``."""
    return F.floor(((SHARE + PER) * (n - place) - SHARE * n) / F.lit(SHARE))


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(BAND)).cast("int")


def _second_round(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a shared column whose rows are in different components and may still link.

    The smaller set of a pair is filed, the larger one (by key among equal sizes) probes.  A set can
    only be found through an n-gram so near its front that what follows can reach the overlap with a
    set of its own size; a probe goes to the bands of sizes between the smallest set it may link to
    and the largest it can still reach from its place.  So rows that differ in too many rare n-grams
    never meet in the frequent ones behind.  The rows of a column, band and component form blocks;
    only pairs within the exact bounds leave the product of two blocks.
    """
    n, reach = F.col("n"), _reach(F.col("n"), F.col("place"))
    least, most = F.ceil(n * SHARE / F.lit(PER)), F.least(n, reach)
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK_ROWS)).alias("chunk")
    many = columns.where("size > 2").select("gram", "key", "n", "place", "central", chunk)
    rows = many.join(labels, "key")
    # What a column has filed, band by band: the components there and how far they reach.
    band = F.struct(
        F.col("band"), F.min("label").alias("x"), F.max("label").alias("y"), F.max(reach).alias("far")
    ).alias("b")
    filed_rows = rows.where(reach >= n).withColumn("band", _band(n))
    bands = filed_rows.groupBy("gram", "band").agg(band).groupBy("gram").agg(F.collect_list("b").alias("bands"))
    reached = F.filter(
        "bands",
        lambda b: b["band"].between(_band(least), _band(most))
        & (b["far"] >= n)
        & ((b["x"] != F.col("label")) | (b["y"] != F.col("label"))),
    )
    asking = rows.join(bands, "gram").withColumn("band", F.explode(F.transform(reached, lambda b: b["band"])))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        held = F.collect_list(F.struct("key", "n", "place", "central")).alias(f"{name}_rows")
        return side.groupBy("gram", "band", F.col("label").alias(f"{name}_label"), "chunk").agg(held).drop("chunk")

    probes = blocks(asking.drop("bands"), "probe")
    filed = blocks(filed_rows.join(asking.select("gram", "band").distinct(), ["gram", "band"], "left_semi"), "filed")
    met = probes.join(filed, ["gram", "band"]).where("probe_label <> filed_label")

    def fits(p: Column, q: Column) -> Column:
        larger = (p["n"] > q["n"]) | ((p["n"] == q["n"]) & (p["key"] > q["key"]))
        return larger & _may_link(p["n"], p["place"], q["n"], q["place"])

    def pair(p: Column, q: Column) -> Column:
        first = (p["central"] > q["central"]) | ((p["central"] == q["central"]) & (p["key"] > q["key"]))
        one = F.struct(p["key"].alias("a"), q["key"].alias("b"))
        return F.when(first, one).otherwise(F.struct(q["key"].alias("a"), p["key"].alias("b")))

    def with_filed(p: Column) -> Column:
        return F.transform(F.filter("filed_rows", lambda q: fits(p, q)), lambda q: pair(p, q))

    product = F.flatten(F.transform("probe_rows", with_filed))
    across = met.select(F.explode(product).alias("p")).select("p.a", "p.b")
    # Columns of two rows are pairs already.
    two = columns.where("size = 2").select(F.col("leader.key").alias("a"), F.col("key").alias("b")).distinct()
    label = lambda side: labels.select(F.col("key").alias(side), F.col("label").alias(f"{side}_label"))
    apart = two.join(label("a"), "a").join(label("b"), "b").where("a_label <> b_label").select("a", "b")
    return across.union(apart).distinct()


def _first_round(columns: DataFrame) -> DataFrame:
    """Each row with the most central of its columns' leaders that it may link to."""
    other = F.col("leader")
    fits = _may_link(F.col("n"), F.col("place"), other["n"], other["place"]) & (other["key"] != F.col("key"))
    best = columns.where(fits).groupBy("key").agg(F.max(F.struct("leader.central", "leader.key"))["key"].alias("a"))
    return best.select("a", F.col("key").alias("b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach.  A text without words (or null) has no
    n-grams and stays alone; one with fewer than five words is one n-gram.  Rows of equal sets are
    one class, so repeated rows never meet.  Rows with a null id are linked, and their component
    takes the smallest id that is not null.  Other columns are not read.
    """
    scanned = stage(_scan_sets(docs), "join-scan")
    rows = scanned.where("block is null").select("doc_id", "n", "key")
    classes = stage(
        rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "join-classes"
    )
    columns = _columns(_entries(docs, _sketch(scanned)))
    keys = columns.select(F.explode(F.array("key", F.when(F.col("size") == 2, F.col("leader.key")))).alias("key"))
    nodes = stage(keys.where("key is not null").distinct().withColumn("label", F.col("key")), "join-nodes")
    first = stage(_first_round(columns), "join-star")
    star = _linked(first, docs, classes)
    labels = stage(components(star, nodes), "join-first")
    more = _linked(_second_round(columns, labels).join(first, ["a", "b"], "left_anti"), docs, classes)
    final = components(star.union(more), nodes)
    # A component's name is the smallest id of its classes.
    names = classes.join(final, "key", "left").select(
        "key", "doc_id", F.coalesce("label", "key").alias("label")
    )
    lowest = names.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stage(names.join(lowest, "label").select("key", "component_id"), "join-named")
    return rows.join(named, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component; columns as in ``docs``.

    An id on several rows stays if one of them is its component's smallest, and equal texts of that
    id are kept once.  Rows without an id can't be told apart and stay.
    """
    named = stage(jaccard_components(docs).where("doc_id is not null"), "join-components")
    ids = named.groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows")
    )
    ids = stage(ids.where("not stays or rows > 1"), "join-decided").withColumnRenamed("doc_id", "__id")
    lost, again = ids.where("not stays"), ids.where("stays and rows > 1")
    same = F.col("doc_id") == F.col("__id")
    kept = docs.join(lost.select("__id"), same, "left_anti")
    if again.isEmpty():
        return kept
    several = kept.join(again.select("__id"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again.select("__id"), same, "left_anti").unionByName(several)
