"""The whole way from raw records to ranked companies, as one lazily evaluated plan.

Every posting leaves by exactly one route: kept, filtered (no design job) or merged into another; ``Run.reconcile`` counts the routes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazario.common import blank_to_null, durable
from plazario.functions.posting import bind
from plazario.functions.text import title_core
from plazario.operators import companies, dedupe, labels
from plazario.operators.rules import any_hit


@dataclass
class Run:
    """Layers of a run; ``seen`` counts what came in."""

    seen: DataFrame
    postings: DataFrame
    labelled: DataFrame
    companies: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.labelled.where(F.col("level") != "NOT_DESIGN")

    @property
    def filtered(self) -> DataFrame:
        """What was left out, with the words that decided; nothing is dropped silently."""
        return self.labelled.where(F.col("level") == "NOT_DESIGN").select("job_id", "title_raw", "company_name_raw", F.lit("NOT_DESIGN").alias("reason"), "hits")

    def reconcile(self) -> DataFrame:
        """Sightings that came in against the postings of either route and the sightings folded into them, as these postings tell: a row lost or counted twice unbalances it."""
        merged = self.labelled.agg(F.sum(F.col("n_sightings") - 1).alias("n"))
        return dedupe.reconcile(self.seen.agg(F.sum("n_sightings").alias("n")), self.kept.agg(F.count("*")), self.filtered.agg(F.count("*")), merged)


def postings_of(raw: DataFrame, today: Column) -> DataFrame:
    """Raw records (seq, job_id, source, title, company, ...) as postings."""
    bound = bind(raw, today)
    return bound.select(
        "seq", "job_id", "source", F.col("title").alias("title_raw"), F.col("company").alias("company_name_raw"), "company_key", F.col("company_url").alias("company_linkedin_url"), F.col("location").alias("location_raw"), "location_bucket",
        "posted_at", "posted_confidence", F.col("description").alias("description_text"), "li_seniority_field", "li_industries", "dedupe_key", F.array().cast("array<string>").alias("merged_ids"), F.lit(1).alias("n_sightings"), "parse_warnings",
    )


def label(postings: DataFrame) -> DataFrame:
    """Postings with level, role and the hits behind them."""
    role = labels.role(F.col("title_raw"))
    out = labels.with_level(postings, "title_raw", "description_text", "li_seniority_field", "verdict").withColumns({"role_verdict": role, "hits": labels.level_hits(F.col("title_raw"))})
    return out.withColumns({"level": F.col("verdict.label"), "level_confidence": F.col("verdict.confidence"), "role": F.col("role_verdict.label"), "role_second": F.col("role_verdict.second")}).drop("verdict", "role_verdict")


def merged_postings(postings: DataFrame) -> DataFrame:
    """Postings merged by identifier, then by repost key, then by likeness of their titles within a company and bucket, in order of first arrival."""
    ids = postings.where(blank_to_null("job_id").isNotNull()).groupBy("job_id").agg(F.min("seq").alias("came"))
    by_id = durable(dedupe.merge(postings, "job_id").join(ids, "job_id", "left").withColumn("arrival", F.coalesce("came", "seq").cast("bigint")).drop("came"))
    keys = by_id.where(blank_to_null("dedupe_key").isNotNull()).groupBy("dedupe_key").agg(F.min("arrival").alias("came"))
    by_key = dedupe.merge(by_id, "dedupe_key").join(keys, "dedupe_key", "left").withColumn("arrival", F.coalesce("came", "arrival")).drop("came")
    by_key = durable(by_key.withColumn("core", F.coalesce(title_core("title_raw"), F.lit(""))))
    keyed = by_key.join(dedupe.repost_groups(by_key), "arrival", "left")
    return durable(dedupe.merge(keyed, "repost").select(*postings.columns))


def process(postings: DataFrame, today: Column) -> Run:
    """Merge by identifier, by repost key and by likeness of titles; label; roll up and rank companies."""
    merged = merged_postings(postings)
    labelled = label(merged)
    kept = labelled.where(F.col("level") != "NOT_DESIGN").where("company_key is not null")
    sure = F.coalesce("posted_confidence", F.lit(0.5))
    factors = kept.groupBy("company_key").agg(
        F.max(companies.recency(F.datediff(today, F.col("posted_at")), sure)).alias("recency"), F.max(F.when(any_hit(F.col("location_bucket"), ["MADRID", "REMOTE_ES"]), 1.0).otherwise(0.3)).alias("place"),
        F.min("location_bucket").alias("bucket"), F.array_sort(F.collect_set("level")).alias("levels"), F.array_sort(F.collect_set("role")).alias("roles"),
    )
    score, strong, weak = companies.weighted([("recency", 50, F.col("recency")), ("place", 30, F.col("place")), ("volume", 20, F.when(F.col("n_jobs") >= 3, 1.0).when(F.col("n_jobs") == 2, 0.7).otherwise(0.3))])
    rolled = companies.rollup(kept, today).join(factors, "company_key").withColumns({"score": score, "strong": strong, "weak": weak})
    return Run(postings, merged, labelled, companies.ranked(rolled, "reciente"))
