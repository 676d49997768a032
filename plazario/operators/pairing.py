"""Pairs of rows that share a key, without a task that ever holds a hot key's whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that are paired directly; a longer list is dealt out over salted slices.
SLICE = 512
#: Left rows of one key that may meet in one task; keys with more are at most one for so many rows, so they are broadcast.
HOT = 100_000


def sliced(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, rows: str, slice_rows: int | None = None) -> DataFrame:
    """Inner equi-join on ``keys`` where both sides carry ``rows``, the (estimated) number of left rows of the key.

    Every left row goes to one of ceil(rows / slice_rows) slices of its key and every right row to all of them, so the join is whole and the work
    on a hot key spreads over as many tasks as it has slices.  An estimate that is off changes only the number of slices,
    but both sides must carry the same one.
    """
    n = F.greatest(F.ceil(F.col(rows) / (slice_rows or SLICE)), F.lit(1)).cast("int")
    a = left.withColumn("slice", F.pmod(F.xxhash64(left_id), n).cast("int")).drop(rows)
    b = right.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1))).drop(rows)
    return a.join(b, [*keys, "slice"]).drop("slice")


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner equi-join with a table of unique ``keys`` that knows, in ``rows``, how many left rows each has.

    Keys with more than HOT rows are told apart and looked up by a broadcast, which holds at most one row for HOT rows of ``left``; the others move.
    """
    hot = F.col(rows) > HOT
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(right.where(hot)), keys).unionByName(rest.join(right.where(~hot), keys))
