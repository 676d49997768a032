"""Near-duplicate records (byte-position inverted index with count filtering, then exact verification).

Every text becomes a signature of one byte for each position (``lists``).  The inverted index lists the texts by position and byte, for ANCHORS positions, with the half-bytes of all positions:
within a list the positions that two texts share are tallied, and pairs below the minimum for the threshold are dropped.  What is left is verified on the word shingles
themselves, so no wrong pair comes out.

What the minimum guarantees: a pair at J = 1/2 agrees at each position with probability 1/2, so it misses all ANCHORS lists, or all divisions of those that are long, or the tally, with
probability about 0.0005; at J = 0.55 below 0.0002.  It is the same for a collection of any size.  Deterministic minima (prefixes of rare shingles) were measured and put aside, see README.

Texts are the same if 128 bits of their word sequences are; the copies of a text are one text through all of this and are put back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazario.common import durable, partitions, spread
from plazario.llm import lists as L
from plazario.llm import shingles as S
from plazario.llm.sieve import may_hold, sieve
from plazario.operators.pairing import looked_up, sliced

FORM = L.Form(words=7, least=41)
#: Words that a description needs.
LEAST_WORDS = 40
THRESHOLD = 0.5
#: Lists are sized on every SAMPLE-th text; only how they are dealt out depends on it.
SAMPLE = 64
_TIMES = L.multipliers(FORM.positions)


def _index_blobs(signatures: np.ndarray, ids: np.ndarray, hot: dict[int, int]) -> pa.RecordBatch:
    """The index of distinct texts: an entry in the list of each anchor position and its byte."""
    anchor = np.tile(np.arange(L.ANCHORS), len(ids))
    rows = L.entries(np.repeat(signatures, L.ANCHORS, axis=0), np.repeat(ids.view(np.uint64), L.ANCHORS), anchor, FORM)
    lists = anchor << 8 | signatures[:, : L.ANCHORS].ravel()
    return L.blobs(*L.dealt(lists, rows, np.repeat(S.mix(ids.view(np.uint64)), L.ANCHORS), hot))


def indexed(texts: DataFrame, title: str, body: str, hot: dict[int, int]) -> DataFrame:
    """(list, blob): the inverted index of the rows whose ``body`` has LEAST_WORDS words; copies within a batch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, signatures = [np.empty(0, np.int64)], [np.empty((0, FORM.positions), np.uint8)]
            for t in S.texts(b.column(0), b.column(1), LEAST_WORDS):
                ids.append(np.array([x for x, _ in t.ids()], np.int64))
                signatures.append(L.signatures(*t.runs(), _TIMES))
            ids, first = np.unique(np.concatenate(ids), return_index=True)
            yield _index_blobs(np.concatenate(signatures)[first], ids, hot)

    return spread(texts.select(title, body)).mapInArrow(run, L.BLOBS)


def hot_lists(texts: DataFrame, key: str, title: str, body: str) -> dict[int, int]:
    """Lists that hold more than BLOCK texts, with the blocks to deal them to: at most 256 for each anchor.  No list is longer than the collection."""
    if texts.count() <= L.BLOCK:
        return {}
    some = indexed(texts.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0), title, body, {})
    sizes = some.groupBy("list").agg((F.sum(F.length("blob")) / (8 * FORM.width) * SAMPLE).alias("n")).where(F.col("n") > L.BLOCK).collect()
    return {r["list"]: -(-int(r["n"]) // L.BLOCK) for r in sizes}


def meetings(index: DataFrame) -> DataFrame:
    """(a, b): ids, a < b, of texts of one list that share enough positions; a pair may come out several times."""

    def found(lists: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = rows[:, -1].view(np.int64)
        order = np.lexsort((ids, lists))
        lists, ids = lists[order], ids[order]
        kept = np.concatenate([[True], (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1])])
        lists, ids, rows = lists[kept], ids[kept], rows[order[kept]]
        columns = [np.ascontiguousarray(rows[:, k]) for k in range(FORM.words + 1)]
        for i, j, _ in L.meet(lists, (lists & 0xFFFFFF) >> 8, columns, FORM):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(ids[i])], ["a", "b"])

    return L.processed(index, FORM, found, "a bigint, b bigint")


def read_again(texts: DataFrame, key: str, title: str, body: str, concerned: np.ndarray) -> DataFrame:
    """(key, id, id2, near, shingles) of the rows whose body has LEAST_WORDS words; ``near`` if the filter holds the text, with its shingles once for each batch."""
    shared = texts.sparkSession.sparkContext.broadcast(concerned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in S.texts(b.column(1), b.column(2), LEAST_WORDS):
                ids = np.array(t.ids(), np.int64).reshape(-1, 2)
                near = may_hold(shared.value, ids[:, 0])
                _, first = np.unique(ids, axis=0, return_index=True)
                told = near & np.isin(np.arange(len(ids)), first)
                own = t.shingles() if told.any() else []
                sets = [own[k].view(np.int64) if x else None for k, x in enumerate(told.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t.rows, pa.int32())), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(near), pa.array(sets, pa.list_(pa.int64()))], ["key", "id", "id2", "near", "shingles"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(key), F.col(title), F.col(body))).mapInArrow(run, f"key {kind}, id bigint, id2 bigint, near boolean, shingles array<bigint>")


def jaccard(a: Column, b: Column) -> Column:
    """Share of distinct shingles in both, exactly; 0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def near_duplicates(df: DataFrame, key: str, title: str, body: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, id, id2), texts (id, id2, rep, copies), and pairs (a, copies_a, b, copies_b, similarity) of representatives that share ``threshold`` of their shingles.

    Rows whose body is null, empty or has fewer than LEAST_WORDS words are in none of them; a null title counts as empty; rows of a null key are left out;
    of rows that repeat a key all take part; very long texts are used whole; empty input gives empty results.
    """
    every = df.where(F.col(key).isNotNull())
    met = durable(meetings(indexed(every, title, body, hot_lists(every, key, title, body))).distinct())
    rows = durable(read_again(every, key, title, body, sieve(met.select(F.explode(F.array("a", "b"))).distinct())))
    texts = rows.groupBy("id", "id2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    # moved by id once, for both sides of the pairs
    sets = rows.where("shingles is not null").select("id", "id2", "shingles").repartition(partitions(df.sparkSession), "id").groupBy("id", "id2").agg(F.first("shingles").alias("shingles"))
    one = met.join(sets.toDF("a", "a2", "sh_a"), "a")
    both = one.join(sets.toDF("b", "b2", "sh_b"), "b").select("a", "a2", "b", "b2", jaccard(F.col("sh_a"), F.col("sh_b")).alias("similarity"))
    linked = both.where(F.col("similarity") >= threshold)
    named = linked.join(texts.toDF("a", "a2", "rep_a", "copies_a"), ["a", "a2"]).join(texts.toDF("b", "b2", "rep_b", "copies_b"), ["b", "b2"])
    swap = F.col("rep_a") > F.col("rep_b")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(o) for x, y, o in (("rep_a", "rep_b", "a"), ("copies_a", "copies_b", "copies_a"), ("rep_b", "rep_a", "b"), ("copies_b", "copies_a", "copies_b"))]
    return rows.select("key", "id", "id2"), texts, named.select(*ends, "similarity")


def members(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, rep, copies): every row with the representative of its text."""
    return looked_up(rows, texts, ["id", "id2"], "copies").select("key", "rep", "copies")


def all_pairs(rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of rows, with copies put back."""
    many = durable(members(rows, texts.where("copies > 1")))
    within = sliced(many.toDF("row_a", "rep", "n"), many.toDF("row_b", "rep", "n"), ["rep"], "row_a", "n").where("row_a < row_b").select("row_a", "row_b")

    def put_back(of: DataFrame, end: str) -> DataFrame:
        # texts without copies need no second look; the rows of a text with many are dealt out over slices
        alone = of.where(F.col(f"copies_{end}") == 1).withColumn(f"row_{end}", F.col(end))
        several = sliced(many.toDF(f"row_{end}", end, "n"), of.where(F.col(f"copies_{end}") > 1).withColumn("n", F.col(f"copies_{end}")), [end], f"row_{end}", "n")
        return alone.unionByName(several)

    across = put_back(put_back(pairs.select("a", "copies_a", "b", "copies_b"), "a"), "b").select("row_a", "row_b")
    both = across.unionByName(within)
    return both.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
