"""Hashes of all substrings of a length at once, for tasks that read Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

# These functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse
PIECE = 1 << 19
_MASK = (1 << 64) - 1
_TABLES: dict[str, np.ndarray] = {}


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; powers of the base and of its inverse."""
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = max(n, 1 << 12)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            powers = np.full(size, base & _MASK, np.uint64)
            powers[0] = 1
            _TABLES[name] = np.cumprod(powers, dtype=np.uint64)
        _TABLES["byte"] = _scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    return _TABLES["byte"], _TABLES["up"], _TABLES["down"]


def window_hashes(data: bytes, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes): one 64-bit number for the substring at each position, length by length.

    One pass of prefix sums serves every length; equal bytes give equal numbers wherever they stand.
    """
    byte, up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    for length in lengths:
        if length <= len(data):
            n = len(data) - length + 1
            yield length, _scrambled((sums[length:] - sums[:n]) * down[:n])


def whole_hash(data: bytes) -> int:
    for _, hashes in window_hashes(data, [len(data)]):
        return int(hashes[0])
    return 0


def bits(hashes, n: int) -> tuple:
    """The two bits, of ``n`` (a power of two, 2 ** 32 at most), that hashes fall on."""
    return hashes & (n - 1), (hashes >> 32) & (n - 1)


def _held(known: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)


def find(data: bytes, lengths: Sequence[int], known: np.ndarray, twice: bool = False) -> Iterator[tuple[int, int]]:
    """(position, length) of the substrings whose bit is set in ``known``, a power of two of words.

    With ``twice``, both of their bits.
    Long data goes in pieces that overlap by the longest length, so memory stays near the piece.
    """
    most = max(lengths, default=0)
    for start in range(0, max(len(data), 1), PIECE):
        piece = data[start : start + PIECE + most - 1]
        for length, hashes in window_hashes(piece, lengths):
            first, second = bits(hashes[:PIECE], len(known) * 64)
            at = np.flatnonzero(_held(known, first))
            for i in (at[_held(known, second[at]) == 1] if twice else at).tolist():
                yield start + i, length
