"""Order MinHash fingerprints: signatures that see the order of a text's k-mers, not their set alone.

K-mers are runs of three words, or of four characters where a text has too few words for two runs.
Repeats of a k-mer are numbered, so that each occurrence is an element of its own.  The 64
permutations are rotations of one hash: permutation b starts at the b-th of 64 bins, goes on through
the bins after it and around.  Each keeps the two minimal elements of the whole text, puts them in
text order and hashes the pair.  Two texts share a signature if they share the elements and their
order, which is why replacing or moving a part lowers the likeness as edit distance grows.

Only SQL expressions over one row's arrays; the only shuffle brings neighbouring documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epithet.llm.common import let, stage, text_or_empty, words

BIN_BITS, POSITION_BITS = 6, 28
CHARACTERS = 4
_MASK = (1 << POSITION_BITS) - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _pack(key: Column, place: Column) -> Column:
    """The leading bits of a hash, then a position: sorts by hash, ties by position."""
    return key.bitwiseAND(F.lit(~_MASK)).bitwiseOR(place.cast("long"))


def _elements(kmers: Column) -> Column:
    """Packed elements of a text: first occurrences by their k-mer, later ones by k-mer and number."""
    key = lambda x: F.shiftright(x, POSITION_BITS)

    def numbered(order: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(order) - 1),
            lambda j: (j == 0) | (key(F.get(order, j)) != key(F.get(order, j - 1))),
        )
        numbers = lambda s: F.flatten(
            F.transform(
                s, lambda at, r: F.sequence(F.lit(0), F.coalesce(F.get(s, r + 1), F.size(order)) - at - 1)
            )
        )
        return F.zip_with(
            order,
            let(starts, numbers),
            lambda x, number: let(
                F.get(kmers, _place(x).cast("int")),
                lambda k: _pack(F.when(number == 0, k).otherwise(F.xxhash64(k, number)), _place(x)),
            ),
        )

    plain = F.transform(kmers, lambda k, i: _pack(k, i))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), plain).otherwise(
        let(F.array_sort(plain), numbered)
    )


def fingerprint(text: Column, size: int = 3) -> Column:
    """Signatures of a text that is not null, one number for each of the 64 permutations.

    The permutation stands above 32 bits of the pair's hash.  A text without words has none.  One of
    at most ``size`` words is taken by its characters, blanks as one space; below ``CHARACTERS`` + 1
    of them it is a single k-mer, the only case without order.
    """

    def runs(units: Column, length: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(units) - length, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(length)]),
        )

    def kmers(w: Column) -> Column:
        characters = F.filter(F.split(F.array_join(w, " "), ""), lambda c: c != "")
        return (
            F.when(F.size(w) > size, runs(w, size))
            .when(F.size(w) > 0, let(characters, lambda c: runs(c, CHARACTERS)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # Signed, as the elements are sorted: from -half to half - 1.
    bin_of, half = lambda x: F.shiftright(x, 64 - BIN_BITS).cast("int"), 1 << BIN_BITS - 1

    def signatures(minimal: Column) -> Column:
        n = F.size(minimal)
        firsts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: (j == 0) | (bin_of(F.get(minimal, j)) != bin_of(F.get(minimal, j - 1))),
        )

        def pair(x: Column, y: Column) -> Column:
            a, b = F.shiftright(x, POSITION_BITS), F.shiftright(y, POSITION_BITS)
            hashed = F.when(n == 1, F.xxhash64(a)).when(_place(x) < _place(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
            return hashed.bitwiseAND(F.lit((1 << 32) - 1))

        def spread(low: Column, high: Column, j: Column) -> Column:
            """The pair at ``j`` for the bins from ``low`` to ``high``."""
            marked = lambda b, p: F.shiftleft(b.cast("long").bitwiseAND(F.lit(2 * half - 1)), 32).bitwiseOR(p)
            return let(
                pair(F.get(minimal, j), F.get(minimal, (j + 1) % n)),
                lambda p: F.transform(F.sequence(low, high), lambda b: marked(b, p)),
            )

        # A bin without elements starts at the first element after it, the last ones at the first of all.
        covered = F.transform(
            firsts,
            lambda j: spread(
                F.when(j == 0, F.lit(-half)).otherwise(bin_of(F.get(minimal, j - 1)) + 1), bin_of(F.get(minimal, j)), j
            ),
        )
        end = bin_of(F.get(minimal, n - 1)) + 1
        around = F.when(end < half, spread(F.least(end, F.lit(half - 1)), F.lit(half - 1), F.lit(0))).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.concat(F.flatten(covered), around)

    def sketch(elements: Column) -> Column:
        # Sorted by bin and rank: an element is among its bin's two if the one two before isn't of the bin.
        two = lambda order: F.filter(
            order, lambda x, j: (j < 2) | (bin_of(x) != bin_of(F.get(order, j - 2)))
        )
        return let(let(F.array_sort(elements), two), signatures)

    empty = F.array().cast("array<bigint>")
    return let(let(words(text), kmers), lambda k: F.when(F.size(k) == 0, empty).otherwise(let(_elements(k), sketch)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the permutations of either fingerprint with the same signature in both; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda s: F.shiftright(s, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_string(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda s: F.lpad(F.lower(F.hex(s)), 10, "0")), "")


def _bucket_of(col: str, bounds: list) -> Column:
    """How many bounds are at or below the value (0 for null), looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col(col)))
    coarse = F.greatest(below(F.lit(bounds[::step])) - 1, F.lit(0)) * step
    return let(coarse, lambda c: c + below(F.slice(F.lit(bounds), c + 1, step)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each document and the next by descending id.

    The last is followed by the first; null ids come last; rows of one id are ordered by their text.
    A null text counts as empty.  Ranges of ids are sorted apart, and the first row of each range
    follows the last of the range before.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    cut = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0]
    bucket = _bucket_of("doc_id", sorted(set(cut or []))).alias("bucket")
    rows = docs.select("doc_id", text_or_empty().alias("text"), bucket)
    order = [F.col("doc_id").desc_nulls_last(), "tie"]
    tie = F.xxhash64("text").alias("tie")
    # The first row of each range, a few thousand at most, in the order of the ranges.
    first = Window.partitionBy("bucket").orderBy(*order)
    heads = stage(
        rows.select("doc_id", tie, "bucket").withColumn("at", F.row_number().over(first)).where("at = 1").drop("at"),
        "omh-heads",
    )
    following = Window.orderBy(F.desc("bucket"))
    top = F.first(F.struct("doc_id", "tie")).over(
        following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    after = heads.select(
        "bucket", F.coalesce(F.lead(F.struct("doc_id", "tie")).over(following), top).alias("next")
    ).select(F.col("bucket").alias("of"), F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))
    edges = stage(
        rows.select("doc_id", "text", tie)
        .join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
        .select("of", F.col("text").alias("edge_text"), fingerprint(F.col("text")).alias("edge_print"))
        .dropDuplicates(["of"]),
        "omh-edges",
    )
    printed = rows.select("doc_id", "text", tie, "bucket", fingerprint(F.col("text")).alias("print"))
    window = Window.partitionBy("bucket").orderBy(*order)
    paired = printed.withColumn("following", F.lead(F.struct("text", "print")).over(window))
    joined = paired.join(edges, (F.col("bucket") == F.col("of")), "left")
    return joined.select(
        "doc_id",
        "text",
        "print",
        F.coalesce("following.text", "edge_text").alias("next_text"),
        F.coalesce("following.print", "edge_print").alias("next_print"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likeness and that to the next.

    An edited text has its last third replaced by the beginning of the next document.  A null text is
    empty; empty texts have a fingerprint of their own and are alike.  Ids are numbers (their order is
    cut by quantiles); rows of one id are ordered by their text, and null ids come last.  Other
    columns are ignored; an empty table gives no rows.
    """
    third = F.floor(F.char_length("text") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - third)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs.select("doc_id", "text")).withColumn("edited", edited)
    both = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("print")).alias("fingerprint"),
        as_string(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
