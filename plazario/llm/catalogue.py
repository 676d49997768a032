"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazario.common import broadcast_if_small, durable, table
from plazario.llm import history, mixing, names, near, pii, places, plain, residue, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["seq", "job_id", "title_raw", "description_text"]
    return history.known_again(table(spark, sf_dir, "new_batches", *columns), table(spark, sf_dir, "postings", *columns), *columns)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = table(spark, sf_dir, "postings", "job_id", "company_name_raw")
    linked = names.variants(postings, "company_name_raw", table(spark, sf_dir, "deny_entries"), table(spark, sf_dir, "allow_entries"))
    return linked.select("entry_id", "job_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.found(table(spark, sf_dir, "postings", "job_id", "location_raw"), table(spark, sf_dir, "places"), "job_id", "location_raw")


def p4_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with a place as typed, the entry it means and its bucket; unmatched values keep place 0 and no bucket."""
    read = places.mapped(table(spark, sf_dir, "postings", "job_id", "location_raw"), table(spark, sf_dir, "places"), "job_id", "location_raw")
    entries = broadcast_if_small(table(spark, sf_dir, "places", "place_id", "place_name", "location_bucket"), places.MOST_ENTRIES)
    return read.where("place_id is not null").join(entries, "place_id", "left").select(F.col("key").alias("job_id"), "place_id", "place_name", "location_bucket")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "postings", "job_id", "title_raw", "description_text"), "job_id", "title_raw", "description_text")
    return near.all_pairs(*found).toDF("job_id_a", "job_id_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting with the class of its text, the size of the class and the links of the class to other texts."""
    rows, texts, pairs = near.near_duplicates(table(spark, sf_dir, "postings", "job_id", "title_raw", "description_text"), "job_id", "title_raw", "description_text")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    linked = near.members(rows, texts).join(links, "rep", "left")
    return linked.select(F.col("key").alias("job_id"), F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_residue(spark, sf_dir).where("residue is not null").select("job_id")


def p5_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with the kind of residue in its description, null for a real one."""
    return residue.labelled(table(spark, sf_dir, "postings", "job_id", "description_text"), "job_id", "description_text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "postings", "job_id", "title_raw", "company_name_raw")
    return plain.not_plain(rows, "job_id", ["title_raw", "company_name_raw"]).select("job_id", "field_name")


def p7_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "postings", "job_id", "title_raw", "company_name_raw")
    return plain.plain_columns(rows, ["title_raw", "company_name_raw"]).select("job_id", "title_raw_plain", "company_name_raw_plain")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.encode_column(docs, "text", "ids", tokens.vocabulary_path("byte_bpe_50k"), ["doc_id"])


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return tokens.count_column(docs, "text", "n_tokens", tokens.vocabulary_path("byte_bpe_50k"), ["doc_id", "source"])


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sizes are cut: three passes over them follow and tokenizing is the dear part
    return mixing.mix(durable(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(durable(mixing.mix(durable(_sized(spark, sf_dir)), targets)), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return pii.items(docs, "doc_id", "text", "lang", table(spark, sf_dir, "person_names")).select("doc_id", "kind", "start_at")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return pii.redacted(docs, "doc_id", "text", "lang", table(spark, sf_dir, "person_names"))


def queries() -> dict:
    own = [p1_found, p2_found, p3_found, p3_classes, p4_found, p4_buckets, p5_found, p5_residue, p7_found, p7_plain, p8_ids, p9_mixture, p9_shares, p10_found, p10_redacted]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
