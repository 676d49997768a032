"""Words, word shingles and content-defined chunks of texts, hashed for whole batches at a time."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash

#: Words of a shingle.
WORDS = 3
_MARKS = regex.compile(r"\p{M}+")
_RUNS = regex.compile(r"[\p{L}\p{N}]+")
#: Punctuation beyond Latin-1; it only separates words.
_APART = re.compile("[‐-‧‰-⁞]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of 0 to 8 characters within eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPECIAL = b"\x01"


def _folded(code: int) -> int:
    """A Latin-1 character as a letter or digit without case and accent, as a blank, or as special where that is not one ASCII character."""
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", chr(code))).lower()
    found = _RUNS.findall(plain)
    return 32 if not found else ord(plain) if len(plain) == 1 and plain.isascii() else _SPECIAL[0]


_FOLD = bytes(map(_folded, range(256)))


def fold(text: str | None) -> bytes:
    """Runs of letters and digits without case and accents, in UTF-8, with blanks between them."""
    if not text:
        return b""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        try:
            raw = _APART.sub(" ", text).encode("latin-1")
        except UnicodeEncodeError:
            raw = _SPECIAL
            out = raw
        else:
            out = raw.translate(_FOLD)
    else:
        out = raw.translate(_FOLD)
    if _SPECIAL not in out:
        return out
    return b" ".join(w.encode() for w in _RUNS.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, without case and accents, in UTF-8."""
    return fold(text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hash_words(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and length of every word of a folded text: eight bytes at a time for all words at once."""
    padded = b" " + folded + b" " * 8
    blank = np.frombuffer(padded, np.uint8) == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    h = mix(eight[start] & _FIRST[np.minimum(size, 8)])
    at, long = 8, np.flatnonzero(size > 8)
    while len(long):
        h[long] = mix(h[long] * _A ^ (eight[start[long] + at] & _FIRST[np.minimum(size[long] - at, 8)]))
        at += 8
        long = long[size[long] > at]
    return h, start - 1, size


@dataclass
class Texts:
    """Word hashes of several texts: text k, from row ``rows[k]``, has the words ``first[k]`` to ``first[k + 1]``."""

    rows: list[int]
    hashes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)

    def ids(self) -> list[tuple[int, int]]:
        """128 bits of each text's sequence of words, as two signed numbers."""
        out = []
        for a, b in pairwise(self.first.tolist()):
            whole = xxhash.xxh3_128_intdigest(self.hashes[a:b])
            out.append(((whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)))
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all runs of WORDS consecutive words, in the order of the texts, and where each text's begin (a text of fewer words has none)."""
        n = len(self.hashes)
        if n < WORDS:
            return np.empty(0, np.uint64), np.zeros(len(self.first), np.int64)
        h = self.hashes
        kept = np.ones(n, bool)
        for k in range(1, WORDS):
            ends = self.first[1:] - k
            kept[ends[ends >= self.first[:-1]]] = False
        runs = mix(h[:-2] * _A + h[1:-1] * _B + h[2:] * _C)[kept[:-2]]
        return runs, np.concatenate([[0], np.cumsum(np.maximum(np.diff(self.first) - (WORDS - 1), 0))])

    def shingles(self) -> list[np.ndarray]:
        """Sorted distinct runs of each text."""
        runs, first = self.runs()
        return [_distinct(np.sort(runs[a:b])) for a, b in pairwise(first.tolist())]

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct content-defined chunks of each text and where each text's begin.

        The value of a chunk is a hash, with its bytes (16 MB for a longer one) in the low LENGTH_BITS.  A boundary falls where the rolling hash of the last two words says so and no such
        place lies within the LEAST words before.  That looks at the words nearby only, so an edit moves the boundaries next to it and all other chunks keep their values.
        """
        n = len(self.hashes)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(self.first), np.int64)
        of = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        begin, end = self.first[of], self.first[of + 1]
        cut = np.flatnonzero(mix(self.hashes[1:] * _B + self.hashes[:-1] * _C) % EVERY == 0) + 1
        cut = cut[begin[cut] < cut]  # both words in one text; the chunk ends with word ``cut``
        before = np.concatenate([[-1], cut[:-1]])
        before = np.where(before >= begin[cut], before, begin[cut] - 1)
        cut = cut[(cut - before >= LEAST) & (end[cut] - 1 - cut >= LEAST)] + 1
        start = np.sort(np.concatenate([self.first[:-1][np.diff(self.first) > 0], cut]))
        inside = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        value = mix(np.add.reduceat(mix(self.hashes ^ mix(inside.astype(np.uint64) + _A)), start))
        value = (value & ~np.uint64(_LENGTH)) | np.minimum(np.add.reduceat(self.sizes + 1, start), _LENGTH).astype(np.uint64)
        text = of[start]
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        kept = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
        return value[kept], np.searchsorted(text[kept], np.arange(len(self.rows) + 1))


#: Texts folded together.
_TOGETHER = 512


def texts(title: pa.Array, body: pa.Array, least: int) -> Iterator[Texts]:
    """The words of title and body of the rows whose body has ``least`` words; nulls count as empty."""
    for at in range(0, len(title), _TOGETHER):
        parts = []
        for t, d in zip(title.slice(at, _TOGETHER).to_pylist(), body.slice(at, _TOGETHER).to_pylist(), strict=True):
            parts += [fold(t), fold(d)]
        ends = np.cumsum([len(p) + 1 for p in parts])
        h, start, size = hash_words(b" ".join(parts))
        first = np.concatenate([[0], np.searchsorted(start, ends)])
        long = first[2::2] - first[1::2] >= least
        n = np.diff(first[::2])
        kept = np.repeat(long, n)
        yield Texts((at + np.flatnonzero(long)).tolist(), h[kept], size[kept], np.concatenate([[0], np.cumsum(n[long])]))


def one_text(title: str | None, body: str | None) -> Texts:
    """A single record, whatever its length."""
    return next(texts(pa.array([title], pa.string()), pa.array([body], pa.string()), 0))


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    first = np.empty(len(ordered), bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


#: A boundary candidate falls after one word in EVERY; LEAST words lie between two candidates at a boundary, and before the end; low bits of a chunk's value hold its bytes.
EVERY, LEAST, LENGTH_BITS = np.uint64(5), 3, 24
_LENGTH = (1 << LENGTH_BITS) - 1


def chunk_bytes(found: np.ndarray) -> int:
    """Bytes of distinct chunks."""
    return int((found & np.uint64(_LENGTH)).sum())
