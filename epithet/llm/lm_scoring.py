"""Language-model scores from a log-frequency Bloom filter.

A count c is stored as its quantised level 1 + floor(log c) to base 1.5: the filter holds the pairs
(n-gram, 1) up to (n-gram, level), and probing level after level until one is missing reads it
back.  The filter lies in segments, one per bucket of n-grams, with a fixed number of bits for each
entry, so it grows with the corpus.  That is why it is not broadcast, as the method would have it: a
filter that holds what a corpus of any size asks for has no size bound.  No task holds more than one
segment; there are as many as the text asks for.  Texts go in chunks, the distinct n-grams of a chunk
go to their buckets once, to be counted and then probed, and what the buckets reply meets the chunk's
texts again.

The probability of a word backs off from three words to two to one: the discounted share of the longer
n-gram in its context, and the discounts' mass on the shorter one.  How many discounts a context has is
estimated, so a context's probabilities add up to at most one.

The base score uses exact word counts, which come with the replies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epithet.llm.common import mix, remainder5, stage, word_hashes

BITS_PER_ENTRY, PROBES, BASE = 16, 6, 1.5
ORDER = 3  # longest n-grams
DISCOUNT = 0.75  # taken off every count above one word
SLICE = 1 << 16  # n-grams that are probed at once
BUCKET_BYTES = 16 << 20  # of text: a bucket counts about as many n-grams as such a text has
FLUSH = 6 << 20  # bytes of text in a chunk, and the rest of its last text
END = np.uint64(0x5851F42D4C957F2D)  # stands before the first word and after the last
_LOW40 = np.uint64((1 << 40) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> np.ndarray:
    """Word hashes and one end."""
    return np.append(word_hashes((text or "").encode()), END)


def grams(tokens: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the n-grams that end at each token, first those of two words, then of three, and so on.

    ``starts`` are the first tokens of the texts; before them stand ends.
    """
    keys, before_all = tokens, np.array([END])
    for n in range(2, ORDER + 1):
        # The n-gram at a token is the shorter one at the token before, and this token.
        before = np.empty_like(keys)
        before[1:] = keys[:-1]
        before[starts] = before_all
        keys = mix(before * _STEP + tokens + np.uint64(n))
        before_all = mix(before_all * _STEP + END + np.uint64(n))
        yield keys


def _starts(texts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, texts[:-1])])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _places(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """Bit places of (key, level), one row per probe, each below ``bits``."""
    first = mix(keys + np.uint64(level * int(_STEP) % (1 << 64)))
    second = mix(first) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (first[None, :] + steps * second[None, :]) % bits.astype(np.uint64)


def fill_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A bucket's segment: all levels of its n-grams."""
    levels = levels_of(counts) if len(counts) else np.zeros(0, np.int64)
    bits = max(64, BITS_PER_ENTRY * int(levels.sum())) // 8 * 8
    segment = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = keys[levels >= level]
        for i in range(0, len(held), SLICE):
            segment[_places(held[i : i + SLICE], level, np.full(1, bits)).ravel().astype(np.int64)] = True
    return np.packbits(segment, bitorder="little").tobytes()


@dataclass(frozen=True)
class CountFilter:
    """Segments of buckets, one after another."""

    data: np.ndarray
    starts: np.ndarray  # first bit of each bucket's segment
    bits: np.ndarray
    top: int = 1 << 10  # the largest level stored, where it is known

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels read back, 0 for n-grams that the filter doesn't hold."""
        parts = [self._levels(keys[i : i + SLICE]) for i in range(0, len(keys), SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        bucket = ((keys >> np.uint64(40)) % np.uint64(len(self.bits))).astype(np.int64)
        low, bits, starts = keys & _LOW40, self.bits[bucket], self.starts[bucket]
        levels = np.zeros(len(keys), np.int64)
        at, level = np.flatnonzero(bits > 0), 1
        while len(at) and level <= self.top:
            places = _places(low[at], level, bits[at]).astype(np.int64) + starts[at]
            held = (self.data[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=0)
            at = at[held]
            levels[at] = level
            level += 1
        return levels

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(keys))


def one_segment(keys: np.ndarray, counts: np.ndarray) -> CountFilter:
    """The filter of one bucket."""
    data = np.frombuffer(fill_segment(keys, counts), np.uint8)
    top = int(levels_of(counts).max()) if len(counts) else 0
    return CountFilter(data, np.zeros(1, np.int64), np.array([8 * len(data)]), top)


@dataclass(frozen=True)
class Model:
    """Corpus sizes: tokens and distinct words of all training texts."""

    n_tokens: int
    n_distinct: int

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n_tokens + 0.5 * (self.n_distinct + 1)))


def _pack40(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and four more for each that is 255 or above; most are 1."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u4", offset=n)
    return counts


def _sum(keys: np.ndarray) -> int:
    """A check that both passes over a chunk have met the same n-grams."""
    return int((keys & _LOW40).sum(dtype=np.uint64))


def _by_bucket(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by bucket, and where each bucket ends."""
    bucket = (distinct >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of a task's rows with the number of their chunk; the same for the same rows in order."""
    number, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, size in enumerate(sizes.tolist()):
            held += size + 1
            if held >= FLUSH:
                yield number, batch.slice(start, i + 1 - start)
                number, held, start = number + 1, 0, i + 1
        if start < batch.num_rows:
            yield number, batch.slice(start)


_PARTIAL = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("asked", pa.bool_())]
    + [(n, pa.binary()) for n in ("words", "word_counts", "pairs", "pair_counts")]
)
_REPLY = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("check", pa.int64())]
    + [(n, pa.binary()) for n in ("exact", "word_levels", "pair_levels")]
    + [("tokens", pa.int64()), ("distinct", pa.int64())]
)
_PARTIAL_SQL = "bucket int, chunk bigint, asked boolean, words binary, word_counts binary, pairs binary, pair_counts binary"
_REPLY_SQL = (
    "bucket int, chunk bigint, `check` bigint, exact binary, word_levels binary, pair_levels binary, "
    "tokens bigint, distinct bigint"
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _partial_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct n-grams of each chunk as packed arrays, with their counts in its training texts."""

    def flush(chunk: int, texts: list[np.ndarray], trained: list[bool], asked: bool) -> pa.RecordBatch:
        tokens = np.concatenate(texts)
        counted = np.repeat(np.array(trained, bool), [len(t) for t in texts])

        def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            distinct, place = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(place[counted], minlength=len(distinct))

        def placed(distinct: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
            order, ends = _by_bucket(distinct, buckets)
            return distinct[order], counts[order], ends

        w, wn, we = placed(*summed(tokens))
        p, pn, pe = placed(*map(np.concatenate, zip(*map(summed, grams(tokens, _starts(texts))), strict=True)))
        out = [
            (
                b, chunk, asked,
                w[we[b] : we[b + 1]].astype("<u8").tobytes(), _pack_counts(wn[we[b] : we[b + 1]]),
                _pack40(p[pe[b] : pe[b + 1]]), _pack_counts(pn[pe[b] : pe[b + 1]]),
            )
            for b in range(buckets)
            if we[b] < we[b + 1] or pe[b] < pe[b + 1]
        ]
        return _table(out, _PARTIAL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, trained, asked = None, [], [], False
        for number, batch in _chunks(batches):
            if texts and number != chunk:
                yield flush(chunk, texts, trained, asked)
                texts, trained, asked = [], [], False
            chunk = number
            texts += [tokens_of(t.as_py()) for t in batch["text"]]
            trained += batch["trained"].to_pylist()
            asked |= any(batch["asked"].to_pylist())
        if texts:
            yield flush(chunk, texts, trained, asked)

    return rows.mapInArrow(count, _PARTIAL_SQL)


def _replies(partial: DataFrame, buckets: int) -> DataFrame:
    """What each bucket answers each chunk, and a row without chunk with the bucket's sizes.

    A bucket sums the counts of its n-grams, fills its segment and probes it with all of them.  The
    words of a chunk get their exact counts and levels, its longer n-grams their levels.
    """

    def answer(bucket: int, held: list[list]) -> Iterator[pa.RecordBatch]:
        def summed(keys: list[np.ndarray], i: int) -> tuple[np.ndarray, ...]:
            every, ends = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
            distinct, place = np.unique(every, return_inverse=True)
            weights = np.concatenate([_unpack_counts(h[i], len(k)) for h, k in zip(held, keys, strict=True)])
            return distinct, place, ends, np.bincount(place, weights, len(distinct)).astype(np.int64)

        asked_words = [np.frombuffer(h[2], "<u8") for h in held]
        asked_pairs = [_unpack40(h[4]) for h in held]
        words, word_place, word_ends, counts = summed(asked_words, 3)
        pairs, pair_place, pair_ends, pair_counts = summed(asked_pairs, 5)
        known, seen = counts > 0, pair_counts > 0
        segment = one_segment(
            np.concatenate((words[known] & _LOW40, pairs[seen])), np.concatenate((counts[known], pair_counts[seen]))
        )
        word_levels = segment.levels(words & _LOW40).astype(np.uint8)
        pair_levels = segment.levels(pairs).astype(np.uint8)
        yield _table([(bucket, None, None, None, None, None, int(counts.sum()), int(known.sum()))], _REPLY)
        for i, (chunk, asked, *_) in enumerate(held):
            if asked:
                w = word_place[word_ends[i] : word_ends[i + 1]]
                p = pair_place[pair_ends[i] : pair_ends[i + 1]]
                check = (_sum(asked_words[i]) + _sum(asked_pairs[i])) % (1 << 62)
                exact = counts[w].astype("<u8").tobytes()
                row = (bucket, chunk, check, exact, word_levels[w].tobytes(), pair_levels[p].tobytes(), None, None)
                yield _table([row], _REPLY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if held and row[0].as_py() != bucket:
                    yield from answer(bucket, held)
                    held = []
                bucket = row[0].as_py()
                held.append([x.as_py() for x in row[1:]])
        if held:
            yield from answer(bucket, held)

    return partial.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _REPLY_SQL)


def _score_chunk(model: Model, buckets: int, texts: list[np.ndarray], replies: list[list]) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base and model log10 probability."""
    tokens = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    words, place = np.unique(tokens, return_inverse=True)
    found = [np.unique(keys, return_inverse=True) for keys in grams(tokens, starts)]
    keys = np.concatenate([distinct for distinct, _ in found])
    replies = sorted(replies, key=lambda r: r[0])
    if sum(r[1] for r in replies) % (1 << 62) != (_sum(words) + _sum(keys)) % (1 << 62):
        raise RuntimeError("two passes over the texts met them in different order: write them to a table first")

    def gathered(distinct: np.ndarray, i: int, kind: str) -> np.ndarray:
        out = np.empty(len(distinct), kind)
        out[_by_bucket(distinct, buckets)[0]] = np.concatenate([np.frombuffer(r[i], kind) for r in replies])
        return out

    exact = gathered(words, 2, "<u8").astype(np.int64)
    guess = count_of(gathered(words, 3, "u1"))
    joint = count_of(gathered(keys, 4, "u1"))
    base = model.log_base(exact)
    ends = guess[np.searchsorted(words, END)]
    share = (10 ** model.log_base(guess))[place]
    context = guess[place]
    first = 0
    for distinct, where in found:
        own = joint[first + where]
        first += len(distinct)
        # The context of a token is the shorter n-gram at the token before; before a text stand ends.
        before = np.append(0.0, context[:-1])
        before[starts] = ends
        seen = np.maximum(before, own)
        with np.errstate(divide="ignore", invalid="ignore"):
            # About as many different words follow as the root of what the own one leaves.
            others = seen - own
            kinds = (own > 0) + np.minimum(others, np.sqrt(others))
            backed = (np.maximum(own - DISCOUNT, 0.0) + DISCOUNT * kinds * share) / seen
        share, context = np.where(seen > 0, backed, share), own
    score = np.log10(share)
    summed = lambda x: np.add.reduceat(x, starts)
    return lengths, summed((exact > 0)[place].astype(np.int64)), summed(base[place]), summed(score)


def _scores(rows: DataFrame) -> DataFrame:
    """Scores of the rows that are asked for, by a model of those to be trained on.

    ``rows`` has doc_id, text, trained and asked.  It is read twice and has to give its rows in the
    same order, as files do; otherwise the query stops.
    """
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes // BUCKET_BYTES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    replies = stage(_replies(_partial_counts(rows, buckets), buckets), "lm-replies")
    sizes = replies.agg(F.sum("tokens"), F.sum("distinct")).first()
    model = Model(sizes[0] or 0, sizes[1] or 0)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _chunks(batches):
            column = pa.array(np.full(batch.num_rows, chunk), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "chunk"])

    def scored(held: list[tuple], texts: list[np.ndarray], replied: list[list]) -> pa.RecordBatch:
        n_tokens, known, base, score = _score_chunk(model, buckets, texts, replied)
        ids = pa.concat_arrays([h[0] for h in held])
        trained = pa.concat_arrays([h[1] for h in held])
        columns = [pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(
            [ids, trained, *columns], ["doc_id", "trained", "n_tokens", "n_known", "base_score", "score"]
        )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, texts, replied = None, [], [], []
        for batch in batches:
            chunks = batch["chunk"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if current != chunks[start]:
                    if texts:
                        yield scored(held, texts, replied)
                    current, held, texts, replied = chunks[start], [], [], []
                part = batch.slice(start, end - start)
                reply = pc.is_valid(part["bucket"])
                own = part.filter(pc.invert(reply))
                if own.num_rows:
                    held.append((own["doc_id"], own["trained"]))
                    texts += [tokens_of(t.as_py()) for t in own["text"]]
                names = ("bucket", "check", "exact", "word_levels", "pair_levels")
                replied += [list(r) for r in zip(*(part.filter(reply)[n].to_pylist() for n in names))]
        if texts:
            yield scored(held, texts, replied)

    texts = rows.mapInArrow(numbered, f"doc_id {kind}, text string, trained boolean, asked boolean, chunk bigint")
    both = texts.where("asked").drop("asked").unionByName(
        replies.where("chunk IS NOT NULL").drop("tokens", "distinct"), allowMissingColumns=True
    )
    return (
        both.repartition(buckets, "chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(
            apply, f"doc_id {kind}, trained boolean, n_tokens bigint, n_known bigint, base_score double, score double"
        )
        .withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    )


_COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A null or empty text has one token, its end.  Words that training lacks count 0.  With no
    training text the model knows nothing: N and V are 0 and every token gets the same share.  Repeated
    rows count as often as they stand, in training and in the result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    asked = docs.select("doc_id", "text", F.lit(False).alias("trained"), F.lit(True).alias("asked"))
    learned = training.select(
        F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(True).alias("trained"), F.lit(False).alias("asked")
    )
    return _scores(asked.union(learned)).select("doc_id", *_COLUMNS)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 5 is not 1.

    A null id is a training row.  See ``score_documents`` for nulls, repeats and empty tables.
    """
    held = F.coalesce(remainder5() == 1, F.lit(False))
    rows = docs.select("doc_id", "text", (~held).alias("trained"), F.lit(True).alias("asked"))
    return _scores(rows).select("doc_id", (~F.col("trained")).alias("held_out"), *_COLUMNS)
