"""Mixing sources to target shares of the tokens (multivariate-hypergeometric splitting tree).

Documents fall into blocks by a hash of their id, so a block is a random part of its source and its number is known
without sorting.  Only the block totals reach the driver: at most ``MOST_BLOCKS`` a source, whatever the corpus
holds.  There each source's quota becomes whole passes over its blocks and a part of one more, cut where the running
token total comes nearest the quota.  The block quotas of all sources are then split between the output shards by a tree
of multivariate-hypergeometric draws: each node draws how many blocks of every source go left and leaves the rest to the
right, which gives every shard an unbiased, exact share of the whole.  Each source's blocks are permuted and dealt
out to the shards in that order without overlap; a shard shuffles its documents locally.

The size of the mixture is the largest that no source limits: min over sources of (tokens * max_repeats / share).  Sources of
the targets without any tokens cannot contribute; they appear in the report with an actual share of 0, and the other shares
keep their proportion.  Documents of no target source, of null source, and without tokens are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazario.common import bounded

#: Blocks a source is cut into at most: bounds what the driver sees and what is broadcast.
MOST_BLOCKS = 4096
#: Sources that the targets may name; the block map has at most MOST_SOURCES * MOST_BLOCKS * (repeats) small rows.
MOST_SOURCES = 64
#: Tokens of one output shard, about.
SHARD_TOKENS = 4_000_000
#: Repeats that a target may allow; also bounds the deals that are broadcast.
MOST_REPEATS = 64
_SEED = 20260301


@dataclass(frozen=True)
class Deal:
    """A block of a source given to a shard in a pass."""

    source: str
    block: int
    repeat_no: int
    shard: int


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quota of each source in each shard, shape (shards, sources): a balanced tree of hypergeometric splits."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, n: int, have: np.ndarray) -> None:
        if n == 1:
            out[first] = have
            return
        left = n // 2
        take = int(have.sum()) * left // n
        drawn = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have * 0
        node(first, left, drawn)
        node(first + left, n - left, have - drawn)

    node(0, shards, quotas.astype(np.int64))
    return out


def plan(blocks: dict[str, np.ndarray], targets: list[tuple[str, float, int]], shard_tokens: int = SHARD_TOKENS, seed: int = _SEED) -> tuple[list[Deal], float]:
    """The deals of a mixture, and its size in tokens, from the token total of each block of each source."""
    usable = [(s, share, reps) for s, share, reps in targets if share > 0 and reps > 0 and s in blocks and blocks[s].sum() > 0]
    if not usable:
        return [], 0.0
    scale = sum(share for _, share, _ in usable)
    size = min(float(blocks[s].sum()) * reps * scale / share for s, share, reps in usable)
    rng, orders, counts = np.random.default_rng(seed), [], []
    for s, share, reps in usable:
        quota, held, order = size * share / scale, blocks[s], []
        total = float(held.sum())
        for repeat in range(reps):
            want = quota - repeat * total
            if want <= 0:
                break
            perm = rng.permutation(len(held))
            perm = perm[held[perm] > 0]
            if want < total * (1 - 1e-12):
                sums = np.concatenate([[0], np.cumsum(held[perm])])
                perm = perm[: int(np.abs(sums - want).argmin())]
            order += [(int(b), repeat) for b in perm]
        orders.append(order)
        counts.append(len(order))
    shards = max(1, math.ceil(size / shard_tokens))
    quotas = split(np.array(counts), shards, rng)
    deals = []
    for k, (s, _, _) in enumerate(usable):
        mixed = rng.permutation(len(orders[k]))
        ends = np.cumsum(quotas[:, k])
        shard_of = np.searchsorted(ends, np.arange(len(mixed)), side="right")
        deals += [Deal(s, *orders[k][i], int(sh)) for i, sh in zip(mixed, shard_of, strict=True)]
    return deals, size


def _blocks(sized: DataFrame, targets: DataFrame, most_blocks: int) -> DataFrame:
    """Documents of the target sources with their block; a source has about one block for every document, ``most_blocks`` at most."""
    n = sized.where(F.col("n_tokens") > 0).groupBy("source").agg(F.least(F.count("*"), F.lit(most_blocks)).alias("n_blocks"))
    named = targets.select("source").distinct().join(n, "source")
    return sized.where(F.col("n_tokens") > 0).join(F.broadcast(named), "source").withColumn("block", F.expr(f"cast(pmod(xxhash64(doc_id, {_SEED}L), n_blocks) as int)"))


def mix(sized: DataFrame, targets: DataFrame, shard_tokens: int = SHARD_TOKENS, most_blocks: int = MOST_BLOCKS, seed: int = _SEED) -> DataFrame:
    """(shard, position_key, source, doc_id, repeat_no, n_tokens): the mixture of ``sized`` (doc_id, source, n_tokens).

    ``targets`` has source, target_share and max_repeats (at most MOST_SOURCES rows; of a repeated source the first counts, null shares
    and repeats count as 0).  Within a shard, rows are sorted by ``position_key``, a random order.  Empty input or targets give no rows.
    """
    spark = sized.sparkSession
    rows = bounded(targets.select("source", F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))), MOST_SOURCES, "mix targets")
    wanted = list({r[0]: (r[0], float(r[1]), int(r[2])) for r in reversed(rows) if r[0] is not None}.values())
    if any(reps > MOST_REPEATS for _, _, reps in wanted):
        raise ValueError(f"max_repeats above {MOST_REPEATS}")
    placed = _blocks(sized.select("doc_id", "source", "n_tokens"), targets.select("source"), most_blocks)
    totals = bounded(placed.groupBy("source", "block").agg(F.max("n_blocks").alias("n"), F.sum("n_tokens").alias("t")), MOST_SOURCES * most_blocks, "blocks")
    blocks: dict[str, np.ndarray] = {}
    for r in totals:
        blocks.setdefault(r["source"], np.zeros(r["n"], np.int64))[r["block"]] = r["t"]
    deals, _ = plan(blocks, sorted(wanted), shard_tokens, seed)
    out = ["shard", "position_key", "source", "doc_id", "repeat_no", "n_tokens"]
    if not deals:
        return placed.select(F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("position_key"), "source", "doc_id", F.lit(0).alias("repeat_no"), "n_tokens").where(F.lit(False))
    dealt = spark.createDataFrame([(d.source, d.block, d.repeat_no, d.shard) for d in deals], "source string, block int, repeat_no int, shard int")
    # the deals are bounded by MOST_SOURCES * most_blocks * MOST_REPEATS rows of some bytes; larger ones are shuffled
    dealt = F.broadcast(dealt) if len(deals) < 1 << 20 else dealt
    mixed = placed.join(dealt, ["source", "block"]).withColumn("position_key", F.xxhash64("doc_id", "repeat_no", F.lit(seed)))
    shards = max(d.shard for d in deals) + 1
    return mixed.repartition(min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "position_key").select(*out)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every target source: (source, target_share, n_tokens, actual_share, n_rows, most_repeats)."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), (F.max("repeat_no") + 1).alias("most_repeats"))
    total = got.agg(F.sum("n_tokens").alias("all_tokens"))
    named = targets.groupBy("source").agg(F.first("target_share").alias("target_share"))
    joined = named.join(got, "source", "left").join(total)  # the total is one row
    n = F.coalesce("n_tokens", F.lit(0))
    return joined.select(
        "source", "target_share", n.alias("n_tokens"), F.coalesce(n / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
