"""Inverted lists of records with their signatures, and the pairs within a list that agree enough.

A signature has one byte for each hash function: a byte of the smallest value that the function gives over the record's shingles, so two records agree at
a position with probability J + (1 - J) / 256, where J is the share of their shingles in both.  What a list carries of a record are two words that the tally of half-bytes
needs for every 16 positions, one word with the other halves of PAIRED bytes, and one word of the caller's.

Lists travel as blobs: a batch of records becomes one blob for each list it touches, so a shuffle moves 8 bytes a word and nothing else.  Within a list every two records are compared if it is
short; in a long one those that share one of eight pairs of bytes, so the work on a list does not grow with its square.  Which bytes these are differs between lists (VARIANTS ways):
records that share no pair in one list may well do in the next.
A list expected to hold more than BLOCK records is dealt out: its records fall into blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that lists are keyed by, those whose whole bytes divide a long list, and ways to choose them.
ANCHORS, PAIRED, VARIANTS = 14, 16, 16
#: Records of a list that are compared without division, at first and within a division.
SHORT, DIVIDED = 48, 4096
#: Records of a list in one task.
BLOCK = 1 << 20
#: Pairs compared at a time.
_SLAB = 1 << 19
_PRIME = np.uint32(0x9E3779B1)
_ONES = np.uint64(0x1111111111111111)
BLOBS = "list bigint, blob binary"


@dataclass(frozen=True)
class Form:
    """What a list carries: ``words`` of 16 half-bytes each, and the least number that must agree, all and in the first two words.

    At J = 1/2 a half-byte agrees with probability 1/2 + 1/32.  ``least`` lies about 3.5 standard deviations below the mean there, ``early`` 3.9.
    """

    words: int
    least: int
    early: int = 6

    @property
    def positions(self) -> int:
        return 16 * self.words

    @cached_property
    def chosen(self) -> np.ndarray:
        """Positions of each variant."""
        return chosen(self.positions)

    @property
    def width(self) -> int:
        """Words of an entry: half-bytes, paired halves, the caller's."""
        return self.words + 2


def chosen(positions: int) -> np.ndarray:
    """The PAIRED positions of each variant, neighbours being pairs: the positions beyond ANCHORS in disjoint parts, each paired in several ways."""
    free = np.arange(ANCHORS, positions)
    parts = len(free) // PAIRED
    out = []
    for v in range(VARIANTS):
        part, shift = free[v % parts :: parts][:PAIRED], v // parts
        out.append(np.stack([part[: PAIRED // 2], np.roll(part[PAIRED // 2 :], shift)], axis=1).ravel())
    return np.array(out)


def multipliers(positions: int, beyond: int = 0) -> np.ndarray:
    """One odd number for each hash function, those ``beyond`` others being left to them."""
    x = np.arange(beyond + 1, beyond + positions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(31)).astype(np.uint32) | np.uint32(1))[None, :]


#: Runs that are hashed together: their table fits the processor's cache.
_TOGETHER = 2048


def signatures(runs: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A byte for each text and hash function; text k has the runs ``first[k]`` to ``first[k + 1]``, repeats do not matter; in slabs of bounded memory."""
    x = (runs >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full((len(first) - 1, times.shape[1]), 0xFFFFFFFF, np.uint32)
    k, at = 0, 0
    while at < len(x):
        to = min(at + _TOGETHER, len(x))
        # texts k to m - 1 have runs from ``at`` to ``to``
        k, m = int(np.searchsorted(first, at, side="right")) - 1, int(np.searchsorted(first, to, side="left"))
        own = np.arange(k, m)[np.diff(first[k : m + 1]) > 0]
        found = np.minimum.reduceat(x[at:to] * times, np.maximum(first[own] - at, 0), axis=0)
        least[own] = np.minimum(least[own], found)
        at = to
    # the smallest value is small: its low bits are brought up before the top byte is taken
    return ((least * _PRIME) >> np.uint32(24)).astype(np.uint8)


def halves(signatures: np.ndarray) -> np.ndarray:
    """Half of each byte, in words of 16."""
    half = signatures & 15
    return (half[:, ::2] | half[:, 1::2] << 4).view(np.uint64)


def tally(a: Column, b: Column) -> Column:
    """Agreeing half-bytes of two arrays of words."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return 16 * F.size(a) - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda n, x: n + x)


def entries(signatures: np.ndarray, own: np.ndarray, variant: np.ndarray, form: Form) -> np.ndarray:
    """One row of ``form.width`` words for each signature, with the ``variant`` of the list it goes to."""
    out = np.empty((len(signatures), form.width), np.uint64)
    out[:, : form.words] = halves(signatures)
    high = np.take_along_axis(signatures, form.chosen[variant], axis=1) >> 4
    out[:, form.words] = np.ascontiguousarray(high[:, ::2] | high[:, 1::2] << 4).view(np.uint64)[:, 0]
    out[:, form.words + 1] = own
    return out


def paired(columns: list[np.ndarray], variant: np.ndarray, form: Form) -> np.ndarray:
    """The pairs of whole bytes of entries, one column for each pair."""
    halves = np.ascontiguousarray(np.stack(columns[: form.words], axis=1)).view(np.uint8)
    at = form.chosen[variant]
    low = np.take_along_axis(halves, at // 2, axis=1) >> (4 * (at % 2)).astype(np.uint8) & 15
    high = columns[form.words][:, None].view(np.uint8)
    low[:, ::2] |= (high & 15) << 4
    low[:, 1::2] |= high >> 4 << 4
    return np.ascontiguousarray(low).view(np.uint16)


def blobs(lists: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """(list, blob) of entries and the lists they belong to."""
    order = np.argsort(lists, kind="stable")
    lists = lists[order]
    first = np.flatnonzero(np.concatenate([[len(lists) > 0], lists[1:] != lists[:-1]]))
    offsets = (np.append(first, len(lists)) * (rows.shape[1] * 8)).astype(np.int64)
    data = np.ascontiguousarray(rows[order])
    blob = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(lists[first]), blob], ["list", "blob"])


def dealt(lists: np.ndarray, rows: np.ndarray, salt: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of hot lists once for each pair of blocks that theirs belongs to; ``hot``: list to number of blocks."""
    if not hot:
        return lists, rows
    n = np.ones(len(lists), np.int64)
    for k, blocks in hot.items():
        n[lists == k] = blocks
    again = np.repeat(np.arange(len(lists)), n)
    other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    own = (salt[again] % n[again].astype(np.uint64)).astype(np.int64)
    a, b = np.minimum(own, other), np.maximum(own, other)
    return np.where(n[again] > 1, lists[again] | (a << 20 | b) << 24 | 1 << 62, lists[again]), rows[again]


def agreeing(columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, form: Form) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs whose tally of half-bytes reaches the least, with the tally."""

    def differ(k: int) -> np.ndarray:
        z = columns[k][i] ^ columns[k][j]
        z |= z >> np.uint64(2)
        z |= z >> np.uint64(1)
        return np.bitwise_count(z & _ONES)

    apart = differ(0) + differ(1)
    near = apart <= 32 - form.early
    i, j, apart = i[near], j[near], apart[near].astype(np.int16)
    for k in range(2, form.words):
        apart += differ(k)
    near = apart <= form.positions - form.least
    return i[near], j[near], form.positions - apart[near]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal neighbours."""
    start = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _all(rows: np.ndarray, start: np.ndarray, size: np.ndarray, late: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every record of a run with those before it, in slabs; ``late``: the records that take part as the later one (none given: all)."""
    before = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(start, size) + before
    kept = before > 0 if late is None else (before > 0) & late[rows[place]]
    place, before = place[kept], before[kept]
    ends = np.cumsum(before)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLAB)))
        n = before[at:to]
        i = np.repeat(place[at:to], n)
        off = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield rows[i], rows[i - np.repeat(n, n) + off]
        at = to


def meet(keys: np.ndarray, variant: np.ndarray, columns: list[np.ndarray], form: Form, late: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, tally) of records of one list (``keys``, sorted) that agree enough, j before i; a pair may come out several times."""
    pairs = paired(columns, variant, form)

    def within(keys: np.ndarray, rows: np.ndarray, least: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        start, size = _runs(keys)
        short = (size > 1) & ((size <= least) | (not free))
        for i, j in _all(rows, start[short], size[short], late):
            yield agreeing(columns, i, j, form)
        long = np.repeat(~short & (size > 1), size)
        if long.any():
            inner, group = rows[long], np.repeat(np.arange(len(size)), size)[long].astype(np.uint64)
            for n, p in enumerate(free):
                divided = group << np.uint64(16) | pairs[inner, p]
                order = np.argsort(divided, kind="stable")
                yield from within(divided[order], inner[order], DIVIDED, free[n + 1 :] + free[:n] if least == SHORT else [])

    yield from within(keys, np.arange(len(keys)), SHORT, list(range(PAIRED // 2)))


#: Records taken together, as far as their lists allow.
_ROWS = 1 << 15


def processed(df: DataFrame, form: Form, found: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``found(list of each row, rows)`` over all lists of (list, blob); a list is never divided between two calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[int] = []
        parts: list[bytes] = []
        held = 0

        def out(upto: int) -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(parts[:upto]), np.uint64).reshape(-1, form.width)
            sizes = [len(p) // (8 * form.width) for p in parts[:upto]]
            yield from found(np.repeat(np.array(lists[:upto], np.int64), sizes), rows)

        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lists and k != lists[-1] and held >= _ROWS:
                    yield from out(len(lists))
                    lists, parts, held = [], [], 0
                lists.append(k)
                parts.append(p)
                held += len(p) // (8 * form.width)
        if lists:
            yield from out(len(lists))

    return df.repartition("list").sortWithinPartitions("list").mapInArrow(run, schema)
