"""At-least-once deliveries reduced to one copy per posting number (exact quotient hash tables).

A posting number is a fixed-width identifier.  A bijection of the identifier space scatters the numbers; the
high bits of the image (the quotient) choose the shard, the rest (the remainder) is stored completely, so two
numbers never share an entry and there are no false matches.  Each input partition first builds its own
tables, which collapses every hot number to one entry before anything is shuffled; entries then move by
quotient and are inserted once into the final tables.  The surplus rows come from an anti-join on the row's own
``seq``, which is unique, so a number that owns a third of the log never meets itself in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazario.common import partitions

#: Identifiers are below 2**ID_BITS: ten decimal digits.
ID_BITS = 34
#: Quotient bits; each quotient is a shard of the table.
QUOTIENT_BITS = 12
_REMAINDER_BITS = ID_BITS - QUOTIENT_BITS
_MASK = np.uint64((1 << ID_BITS) - 1)
_HALF = np.uint64(ID_BITS // 2)
_ODD = (0x2C1B3C6D5 & ((1 << ID_BITS) - 1), 0x297A2D39B & ((1 << ID_BITS) - 1))
_INVERSE = tuple(pow(x, -1, 1 << ID_BITS) for x in _ODD)
_LAST = np.iinfo(np.int64).max

_NUMBER = "(^|[^0-9])0*([1-9][0-9]{9})([^0-9]|$)"
#: First code point of the decimal digits of other scripts that keyboards and feeds produce.
_DIGIT_ZEROS = (0xFF10, 0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)


def posting_number(c: Column | str) -> Column:
    """The ten-digit posting number in a free-form identifier, as bigint; null if there is none.

    Accepts surrounding text, a URL, leading zeros, a trailing ``.0``, digits of other scripts, invisible
    characters, and blanks, dots, hyphens or underscores between digits.
    """
    c = F.col(c) if isinstance(c, str) else c
    digits = "".join(chr(z + i) for z in _DIGIT_ZEROS for i in range(10))
    text = F.regexp_replace(F.translate(c, digits, "0123456789" * len(_DIGIT_ZEROS)), r"\p{Cf}+", "")
    joined = F.regexp_replace(F.regexp_replace(text, r"[.,]0+\s*$", ""), r"([0-9])[\s\p{Z}._-]+(?=[0-9])", "$1")
    found = F.coalesce(*[F.nullif(F.regexp_extract(x, _NUMBER, 2), F.lit("")) for x in (text, joined)])
    return found.cast("bigint")


def permute(ids: np.ndarray) -> np.ndarray:
    """A bijection of [0, 2**ID_BITS)."""
    x = ids.astype(np.uint64)
    if len(x) and int(x.max()) > int(_MASK):
        raise ValueError(f"identifier of more than {ID_BITS} bits")
    for m in _ODD:
        x = (x * np.uint64(m)) & _MASK
        x ^= x >> _HALF
    return x


def restore(images: np.ndarray) -> np.ndarray:
    """The inverse of :func:`permute`."""
    x = images.astype(np.uint64)
    for m in reversed(_INVERSE):
        x = x ^ (x >> _HALF)  # the shift is half the width, so one step undoes it
        x = (x * np.uint64(m)) & _MASK
    return x


@dataclass
class QuotientTable:
    """Entries (first seq, folded) by exact identifier: runs of remainders, addressed by quotient.

    ``starts[q]:starts[q + 1]`` is the run of quotient ``q`` in ``remainders``, so an identifier takes the bits of its remainder and no more.  Insertions are buffered and merged
    when the buffer outgrows the table, so n insertions cost O(n log n) and memory follows the distinct identifiers.
    """

    starts: np.ndarray = field(default_factory=lambda: np.zeros((1 << QUOTIENT_BITS) + 1, np.int64))
    remainders: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    seqs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    folded: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    _new: list = field(default_factory=list)
    _waiting: int = 0

    def insert(self, images: np.ndarray, seqs: np.ndarray, folded: np.ndarray) -> None:
        self._new.append((images.astype(np.uint64), seqs.astype(np.int64), folded.astype(bool)))
        self._waiting += len(images)
        if self._waiting > max(1 << 17, len(self.remainders)):
            self.merge()

    def merge(self) -> None:
        if not self._new:
            return
        held = self.quotients.astype(np.uint64) << np.uint64(_REMAINDER_BITS) | self.remainders
        x, s, f = (np.concatenate(parts) for parts in zip((held, self.seqs, self.folded), *self._new, strict=True))
        order = np.argsort(x, kind="stable")
        x, s, f = x[order], s[order], f[order]
        heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
        kept = x[heads]
        self.starts = np.searchsorted(kept >> np.uint64(_REMAINDER_BITS), np.arange((1 << QUOTIENT_BITS) + 1, dtype=np.uint64))
        self.remainders = (kept & np.uint64((1 << _REMAINDER_BITS) - 1)).astype(np.uint32)
        self.seqs = np.minimum.reduceat(s, heads) if len(heads) else s
        self.folded = np.logical_or.reduceat(f, heads) if len(heads) else f
        self._new, self._waiting = [], 0

    @property
    def quotients(self) -> np.ndarray:
        return np.repeat(np.arange(1 << QUOTIENT_BITS, dtype=np.int32), np.diff(self.starts))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Position of each identifier, -1 where absent: binary search within the quotient's run."""
        self.merge()
        x = permute(ids)
        wanted = (x & np.uint64((1 << _REMAINDER_BITS) - 1)).astype(np.uint32)
        q = (x >> np.uint64(_REMAINDER_BITS)).astype(np.int64)
        low, high = self.starts[q].copy(), self.starts[q + 1].copy()
        end = high.copy()
        while (low < high).any():
            open_ = low < high
            middle = (low + high) // 2
            below = np.zeros(len(low), bool)
            below[open_] = self.remainders[middle[open_]] < wanted[open_]
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        there = low < end
        there[there] = self.remainders[low[there]] == wanted[there]
        return np.where(there, low, -1)

    def __len__(self) -> int:
        self.merge()
        return len(self.remainders)


_ENTRY = "quotient int, remainder bigint, first_seq bigint, folded boolean"


def _entries(t: QuotientTable) -> Iterator[pa.RecordBatch]:
    t.merge()
    q, r = t.quotients, t.remainders.astype(np.int64)
    for i in range(0, len(q), 1 << 16):
        j = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(q[j]), pa.array(r[j]), pa.array(t.seqs[j]), pa.array(t.folded[j])], ["quotient", "remainder", "first_seq", "folded"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = QuotientTable()
    for b in batches:
        t.insert(permute(b["number"].to_numpy()), b["seq"].to_numpy(), b["folded"].to_numpy(zero_copy_only=False))
    yield from _entries(t)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = QuotientTable()
    for b in batches:
        image = (b["quotient"].to_numpy().astype(np.uint64) << np.uint64(_REMAINDER_BITS)) | b["remainder"].to_numpy().astype(np.uint64)
        t.insert(image, b["first_seq"].to_numpy(), b["folded"].to_numpy(zero_copy_only=False))
    yield from _entries(t)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        image = (b["quotient"].to_numpy().astype(np.uint64) << np.uint64(_REMAINDER_BITS)) | b["remainder"].to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(restore(image).astype(np.int64)), b["first_seq"], b["folded"]], ["number", "first_seq", "folded"])


def identifier_table(deliveries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The quotient tables of a message log: one row (quotient, remainder, first_seq, folded) per posting number.

    ``deliveries`` needs ``seq``, ``job_id`` and ``merged_ids``.  ``history`` is an earlier result of this function
    (for instance read back from Parquet): a new batch is inserted into it without reading the old messages.
    A number only ever named in ``merged_ids`` has ``first_seq`` = 2**63 - 1.
    """
    own = posting_number("job_id")
    rows = deliveries.select("seq", own.alias("number"), "merged_ids").where(F.col("number").isNotNull())
    # one row per message and folded number; the message itself comes first, so nothing is read twice
    named = F.transform(F.coalesce("merged_ids", F.array().cast("array<string>")), lambda m: F.struct(posting_number(m).alias("number"), F.lit(_LAST).alias("seq"), F.lit(True).alias("folded")))
    named = F.filter(named, lambda m: m["number"].isNotNull() & (m["number"] != F.col("number")))
    itself = F.array(F.struct(F.col("number"), F.coalesce("seq", F.lit(_LAST)).alias("seq"), F.lit(False).alias("folded")))
    parts = rows.select(F.explode(F.concat(itself, named)).alias("e")).select("e.number", "e.seq", "e.folded")
    entries = parts.mapInArrow(_build, _ENTRY)
    if history is not None:
        entries = entries.unionByName(history.select("quotient", "remainder", "first_seq", "folded"))
    return entries.repartition(partitions(deliveries.sparkSession), "quotient").mapInArrow(_unite, _ENTRY)


def kept_numbers(entries: DataFrame) -> DataFrame:
    """(number, seq) of the one message kept of each number that is not folded into another."""
    rows = entries.mapInArrow(_numbers, "number bigint, first_seq bigint, folded boolean")
    return rows.where(~F.col("folded") & (F.col("first_seq") != _LAST)).select("number", F.col("first_seq").alias("seq"))


def surplus(deliveries: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Rows of ``deliveries`` that are not kept; rows without a posting number are never among them.

    Of each number the row with the smallest ``seq`` is kept; of a number that another row lists in ``merged_ids``
    none is.  Empty input gives empty output; a null ``merged_ids`` names nothing; a row that names itself does not fold
    itself; rows without ``seq`` cannot be ordered and are surplus; other columns are carried, whatever their names.
    """
    entries = identifier_table(deliveries) if entries is None else entries
    numbered = deliveries.where(posting_number("job_id").isNotNull())
    return numbered.join(kept_numbers(entries).select("seq"), "seq", "left_anti").select(*deliveries.columns)


def one_copy(deliveries: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Rows of ``deliveries`` that are kept, one for each number that is not folded (rows without a number excluded)."""
    entries = identifier_table(deliveries) if entries is None else entries
    return deliveries.join(kept_numbers(entries), "seq", "left_semi").dropDuplicates(["seq"])
