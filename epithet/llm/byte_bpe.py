"""Byte-level BPE encoding and decoding in two tiers.

A minimal perfect hash holds the vocabulary: a pre-token that is in it resolves with one probe.
Any other pre-token is merged from its bytes, a doubly linked list whose adjacent pairs wait in a
heap by rank; the rank of a joined pair is again one probe.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from epithet.llm.common import Shared

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
# Remembered pre-tokens and probes of one worker; a full memory is emptied, which costs time only.
MEMORY, PROBES = 1 << 19, 1 << 18


class PerfectHash:
    """Hash and displace: each bucket of keys has a displacement that sends them to free slots."""

    def __init__(self, keys: Sequence[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        slots = np.full(self.n, -1, np.int64)
        shift = np.zeros(self.buckets, np.uint64)
        for b in np.argsort(-counts, kind="stable"):
            members = order[ends[b] - counts[b] : ends[b]]
            if len(members):
                shift[b], places = self._place(hashes[members], slots)
                slots[places] = members
        self.shift, self.slots = shift.tolist(), slots.tolist()

    def _place(self, hashes: np.ndarray, slots: np.ndarray) -> tuple[int, np.ndarray]:
        start, width = 0, 64
        while True:
            tries = np.arange(start, start + width, dtype=np.uint64)
            mixed = (hashes[:, None] ^ (tries * np.uint64(_MULT))[None, :]) * np.uint64(_MULT)
            places = ((mixed >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)
            places = places.astype(np.int64)
            free = (slots[places] < 0).all(axis=0)
            if len(hashes) > 1:
                ranked = np.sort(places, axis=0)
                free &= (ranked[1:] != ranked[:-1]).all(axis=0)
            hit = int(free.argmax())
            if free[hit]:
                return int(tries[hit]), places[:, hit]
            start, width = start + width, min(width * 4, 1 << 16)

    def slot(self, key: bytes) -> int:
        """The key's place if it is one of the keys; any place otherwise."""
        h = xxhash.xxh3_64_intdigest(key)
        mixed = ((h ^ (self.shift[h % self.buckets] * _MULT & _MASK)) * _MULT) & _MASK
        return self.slots[(mixed >> 32) * self.n >> 32]


class ByteBpe:
    """Encoder of one vocabulary: ``tokens[i]`` is the byte string of id ``i``."""

    def __init__(self, tokens: Sequence[bytes], pattern: str):
        self.tokens = list(tokens)
        self.lookup = PerfectHash(self.tokens)
        self.pattern = pattern
        self._reset()

    def _reset(self) -> None:
        self.ids = list(range(len(self.tokens)))
        self.longest = max(map(len, self.tokens))
        self.numerals = [str(i) for i in self.ids]
        self.memory: dict[str, tuple[int, ...]] = {}
        self.probes: dict[bytes, int] = {}
        self.split = regex.compile(self.pattern).findall

    def __getstate__(self) -> tuple:
        return self.tokens, self.lookup, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.tokens, self.lookup, self.pattern = state
        self._reset()

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> ByteBpe:
        """From a file of base64 tokens and ranks; ranks count up from 0."""
        rows = {}
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                rows[int(rank)] = base64.b64decode(token)
        if sorted(rows) != list(range(len(rows))):
            raise ValueError("ranks have gaps")
        return cls([rows[i] for i in range(len(rows))], pattern or public_tokenizers.PATTERN)

    def rank(self, piece: bytes) -> int:
        """The id of a byte string in the vocabulary, or -1."""
        at = self.lookup.slot(piece)
        return at if self.tokens[at] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary."""
        n = len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1") * n
        known, longest = self.probes, self.longest

        def rank(part: bytes) -> int:
            if len(part) > longest:
                return -1
            if (found := known.get(part)) is None:
                if len(known) >= PROBES:
                    known.clear()
                found = known[part] = self.rank(part)
            return found

        # An entry is a pair: its rank, its first byte, its end; it is stale once either part changed.
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i] if alive[i] else n
            if middle >= n or after[middle] != end:
                continue
            alive[middle] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) >= 0:
                    heapq.heappush(heap, (r, i, after[end]))
            left = before[i]
            if left >= 0 and (r := rank(piece[left:end])) >= 0:
                heapq.heappush(heap, (r, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : after[i]]))
            i = after[i]
        return ids

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.rank(raw)
        found = (whole,) if whole >= 0 else tuple(self.merge(raw))
        return tuple(self.ids[i] for i in found)  # shared numbers keep the memory small

    def encode(self, text: str) -> list[int]:
        memory, pieces = self.memory, self.split(text)
        for piece in set(pieces).difference(memory):
            if len(memory) >= MEMORY:
                # Those this text needs stay: the pass below reads them.
                self.memory = memory = {p: memory[p] for p in set(pieces) if p in memory}
            memory[piece] = self.encode_piece(piece)
        return list(chain.from_iterable(map(memory.__getitem__, pieces)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _map_texts(docs: DataFrame, keep: Sequence[str], row: Callable, fields: pa.Schema, bpe: ByteBpe) -> DataFrame:
    """``keep`` columns and what ``row(encoder, text)`` gives; null counts as an empty text."""
    from pyspark.sql.pandas.types import from_arrow_schema

    shared = Shared(docs.sparkSession, bpe)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            # In small parts, so that ids of long texts do not pile up.
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                rows = [row(encoder, text.as_py() or "") for text in piece.column(0)]
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
                kept = [piece.column(i + 1) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + columns, list(keep) + fields.names)

    from pyspark.sql.types import StructType

    kept = StructType([docs.schema[c] for c in keep])
    schema = StructType(kept.fields + from_arrow_schema(fields).fields)
    return docs.select(docs["text"], *[docs[c] for c in keep]).mapInArrow(apply, schema)


def encode(docs: DataFrame, keep: Sequence[str] = ("doc_id",), bpe: ByteBpe | None = None) -> DataFrame:
    """``keep`` columns and ``ids``, one row per input row, nothing shuffled.

    A null or empty text has no ids.  Texts are encoded whole; repeated rows get equal ids.
    """
    fields = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def row(encoder: ByteBpe, text: str) -> tuple:
        ids = encoder.encode(text)
        return len(ids), ids

    return _map_texts(docs, keep, row, fields, bpe or ByteBpe.load())


def decode(encoded: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """``encoded`` with ``ids`` replaced by ``bytes``; null ids give null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = Shared(encoded.sparkSession, bpe or ByteBpe.load())
    others = [c for c in encoded.columns if c != "ids"]
    schema = StructType([encoded.schema[c] for c in others] + [StructField("bytes", BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else shared.value.decode(x.as_py()) for x in batch.column(len(others))]
            kept = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(texts, pa.binary())], others + ["bytes"])

    return encoded.select(*others, "ids").mapInArrow(apply, schema)


def round_trip(docs: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again.

    A null text is empty and has no ids; repeated rows are encoded each; other columns are ignored.
    """
    names = ("ids_sha256", "decoded_sha256")
    fields = pa.schema([("n_tokens", pa.int64()), *[(n, pa.string()) for n in names]])

    def row(encoder: ByteBpe, text: str) -> tuple:
        ids = encoder.encode(text)
        joined = " ".join(map(encoder.numerals.__getitem__, ids))
        decoded = encoder.decode(ids)
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _map_texts(docs, ("doc_id",), row, fields, bpe or ByteBpe.load())
