"""Encoding with a public byte-level BPE vocabulary by per-prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of the prefix's encoding.  An automaton over the
vocabulary's byte strings yields every token that is a suffix of the prefix; the longest whose predecessor (the stored last
token of the shorter prefix) is compatible with it is that token.  Two tokens are compatible if merging their bytes by
rank never joins across the border, which is decided by undoing merges from the border outwards.  Following the
stored tokens back from the end gives the ids that repeated merging would give, in time linear in the piece.

The vocabulary file is a parameter; it is read once on the driver and broadcast after a check of its size, so
executors need neither the file nor a common folder.  Null and empty texts have the empty list of ids; blank texts are
encoded as they are; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plazario.common import spread

VOCABULARY = os.environ.get("PLAZARIO_TOKENIZERS", "/opt/tokenizers")
#: A vocabulary larger than this is refused: it is broadcast.
MOST_VOCABULARY_BYTES = 64 << 20
#: Pieces whose encoding a worker remembers; past it the store starts afresh (speed only, results are the same).
REMEMBERED_PIECES = 1 << 19
#: Longest piece that is remembered.
_REMEMBERED_LENGTH = 64

#: Fixed value: the public pattern that cuts a text into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def read_vocabulary(path: str) -> dict:
    """The model of a byte-level BPE file: id to byte string, and the merges as (left, right, joined) ids in rank order."""
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MOST_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    known = {a for m in merges for a in (*m, "".join(m))} | {x for x in vocab if len(x) == 1}
    bytes_of = {vocab[s]: bytes(letters[c] for c in s) for s in known if s in vocab}
    return {"bytes": bytes_of, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]}


class Encoder:
    """Exact byte-level BPE encoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.merge_rank, self.rank, self.parts = {}, {}, {}
        for rank, (a, b, c) in enumerate(vocabulary["merges"]):
            self.merge_rank[a, b] = rank
            if c not in self.rank:  # the merge that makes the token is the first that gives its bytes
                self.rank[c] = rank
                self.parts[c] = (a, b)
        self.length = {i: len(b) for i, b in vocabulary["bytes"].items()}
        self.whole = {b: i for i, b in vocabulary["bytes"].items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, b in vocabulary["bytes"].items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.memory: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` can stand next to each other in an encoding."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED_PIECES:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, the latest first.

        While both sides stand, a merge across the border made at a rank before either side's was complete
        would have come first; then the two tokens cannot occur together.
        """
        merge_rank, rank, parts = self.merge_rank, self.rank, self.parts
        bound = 1 << 60  # the present pair at the border exists until the merge of this rank
        while True:
            across = merge_rank.get((left, right))
            if across is not None and across < bound:
                return False
            at_left, at_right = rank.get(left, -1), rank.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            # merging runs from the left: of two equal merges the left one comes first
            if at_left > at_right:
                bound, left = at_left, parts[left][1]
            else:
                bound, right = at_right + 1, parts[right][0]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        raw = text.encode("utf-8")
        whole = self.whole.get(raw)
        if whole is not None:
            return [whole]
        last: list[int] = [-1] * (len(raw) + 1)
        length, compatible = self.length, self.compatible
        matches: list[list[int]] = [[] for _ in range(len(raw))]
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            matches[end].append(token)
        for end, tokens in enumerate(matches):
            if len(tokens) > 1:
                tokens.sort(key=length.__getitem__, reverse=True)
            for token in tokens:
                start = end + 1 - length[token]
                if start == 0 or last[start] >= 0 and compatible(last[start], token):
                    last[end + 1] = token
                    break
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for null and for the empty text."""
        if not text:
            return []
        out, memory = [], self.memory
        for p in self.pieces.findall(text):
            ids = memory.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= _REMEMBERED_LENGTH:
                    if len(memory) >= REMEMBERED_PIECES:
                        memory.clear()
                    memory[p] = ids
            out += ids
        return out


_HERE: dict[tuple, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, built once a process."""
    if shared.value["key"] not in _HERE:
        _HERE.clear()
        _HERE[shared.value["key"]] = Encoder(shared.value)
    return _HERE[shared.value["key"]]


def vocabulary_path(name: str, folder: str = VOCABULARY) -> str:
    return f"{folder}/{name}.json"


def share(spark, path: str):
    """Broadcast of the vocabulary at ``path``."""
    return spark.sparkContext.broadcast(read_vocabulary(path) | {"key": (path, os.path.getmtime(path))})


def encode_column(df: DataFrame, text: str, out: str, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and ``out``, the ids of column ``text``."""
    shared = share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared).encode
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = pa.array([encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*keep, out])

    rows = spread(df.select(*keep, df[text].alias("text to encode")))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def count_column(df: DataFrame, text: str, out: str, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and ``out``, the number of ids of column ``text``."""
    shared = share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared).encode
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, out])

    rows = spread(df.select(*keep, df[text].alias("text to encode")))
    return rows.mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())]))
