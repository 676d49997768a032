"""Session helpers shared by every operator: table access, durable cuts, bounded collects."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class NoSharedFolder(RuntimeError):
    """A cluster session does not name the folder for checkpoints."""


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a local session (tests, a laptop) without that setting gets a temporary one, any other is refused.
    What the plan had shuffled is no longer needed then and let go of, so that its disk is free for what follows.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise NoSharedFolder("spark.checkpoint.dir is not set: checkpoints must go to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plazario-")
        sc.setCheckpointDir(folder)
    cut = df.checkpoint(eager=True)
    del df
    for _ in range(2):  # what one collection finds, its finalisers let go of
        gc.collect()
        sc._jvm.System.gc()
        time.sleep(0.1)
    return cut


class TooManyRows(ValueError):
    """A table that must be small is not."""


def bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a reference table, refusing more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyRows(f"{what}: more than {limit} rows; use the sharded form")
    return rows


def broadcast_if_small(cut: DataFrame, most: int) -> DataFrame:
    """``cut``, a narrow reference table, marked for broadcast if it has at most ``most`` rows; otherwise joins shuffle."""
    return F.broadcast(cut) if cut.count() <= most else cut


def partitions(spark: SparkSession) -> int:
    """Reduce-side parallelism of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scan for a CPU-heavy Python stage: rebalanced only if it has too few splits to keep the session's cores busy.

    ``df`` must be a scan with narrow operations.  Large inputs have splits enough, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, 6) // 2 else df.repartition(cores)


def blank_to_null(c) -> F.Column:
    """Null for null, empty and blank strings."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def literal_strings(items: Iterable[str]) -> F.Column:
    """An array<string> literal."""
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")
