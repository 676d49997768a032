"""The raw layer: records by run, identifiers seen, scan order and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = (
    "seq bigint, run_id string, job_id string, source string, url string, title string, company string, company_url string, location string, posted_text string, posted_iso string, company_logo_url string, "
    "workplace_type string, description string, li_seniority_field string, li_industries array<string>, parse_warnings array<string>"
)


def save_raw(df: DataFrame, folder: str) -> None:
    df.write.mode("append").partitionBy("run_id").json(f"{folder}/raw")


def runs(spark: SparkSession, folder: str) -> list[str]:
    """Run ids of the raw layer, oldest first: the names of its folders, one for each run; no record is read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/raw")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()]
    return sorted(n.removeprefix("run_id=") for n in names if n.startswith("run_id="))


def load_raw(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """Records of a run, by default the latest: run ids sort by time, so the greatest name wins and only its folder is read."""
    df = spark.read.schema(RAW).json(f"{folder}/raw")
    return df.where(F.col("run_id") == (run_id or runs(spark, folder)[-1]))


def append_seen(df: DataFrame, folder: str) -> None:
    df.select("job_id").distinct().write.mode("append").parquet(f"{folder}/seen")


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose identifier is not in ``seen``."""
    return df.join(seen.select("job_id").distinct(), "job_id", "left_anti")


def rotation(queries: DataFrame, pages: int) -> DataFrame:
    """(page, query columns...): the first page of every query before any second page."""
    return queries.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))


def fair_cap(df: DataFrame, most: int, page: str = "page", query: str = "query_order", position: str = "position") -> DataFrame:
    """At most ``most`` records in page-major order; a record met by several queries counts where it was met first.

    The cut is found by counting records page by page, so only the page it falls in is sorted.
    """
    first = df.groupBy("job_id").agg(F.min(F.struct(page, query, position)).alias("at")).select("job_id", "at.*")
    counts = first.groupBy(page).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a page
    placed = first.join(before.where(F.col("before") < most), page)
    whole = placed.where(F.col("before") + F.col("n") <= most).select("job_id")
    cut = placed.where(F.col("before") + F.col("n") > most)
    rank = F.row_number().over(Window.partitionBy(page).orderBy(query, position, "job_id"))
    return whole.unionByName(cut.withColumn("rank", rank).where(F.col("before") + F.col("rank") <= most).select("job_id"))
