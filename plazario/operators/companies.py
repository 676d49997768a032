"""Companies from postings: rollup, lookups in reference lists, likeness, phrase and industry scores, weighted score, order."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazario.common import blank_to_null, literal_strings
from plazario.functions.text import tokens

#: Likeness of names: sure and weak; names shorter than LEAST_LETTERS are never compared.
FUZZY_SURE, FUZZY_WEAK, LEAST_LETTERS = 0.93, 0.86, 6
#: What descriptions of intermediaries and of end clients say, with weights.
PHRASES = {
    "STAFFING": (-3, [
        "para uno de nuestros clientes", "nuestro cliente busca", "nuestro cliente es", "importante empresa del sector", "empresa lider en su sector", "reconocida empresa del sector", "seleccionamos para",
        "proceso de seleccion para nuestro cliente", "nuestro cliente, una", "on behalf of our client", "our client is looking", "headhunting", "empresa de trabajo temporal",
    ]),
    "AGENCY": (-2, [
        "nuestros clientes", "proyectos de cliente", "client projects", "multi-cliente", "somos una agencia", "somos una consultora", "partner tecnologico", "fabrica de software", "outsourcing", "en las oficinas del cliente",
        "clientes de diferentes sectores", "cartera de clientes",
    ]),
    "END_CLIENT": (2, [
        "nuestro producto", "our product", "nuestros usuarios", "our users", "nuestra app", "nuestra plataforma", "in-house", "equipo interno de diseno", "roadmap de producto", "product roadmap", "nuestro equipo de producto",
        "nuestros clientes finales",
    ]),
}


def common_spelling(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, display_name, n): the most frequent spelling, the largest on ties; blank ones do not count."""
    counted = df.where(blank_to_null(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by(name, F.struct("n", name)).alias("display_name"), F.max("n").alias("n_display"))


def rollup(postings: DataFrame, today: Column) -> DataFrame:
    """One row for each company: postings, newest, spellings, industries, best posting.  Only partial aggregates move."""
    best = F.struct(F.coalesce("posted_at", F.lit("0001-01-01").cast("date")), -F.col("seq"))
    base = postings.groupBy("company_key").agg(
        F.count("*").alias("n_jobs"), F.max("posted_at").alias("latest"), F.coalesce(F.min(F.datediff(today, F.col("posted_at"))), F.lit(9999)).alias("days_min"),
        F.array_sort(F.collect_set("company_name_raw")).alias("spellings"), F.max_by("job_id", best).alias("best_job_id"),
        F.min_by("company_linkedin_url", F.when(F.col("company_linkedin_url").isNotNull(), F.col("seq"))).alias("company_url"), F.array_sort(F.collect_set("location_bucket")).alias("buckets"),
    )
    return base.join(common_spelling(postings, "company_key", "company_name_raw"), "company_key", "left")


def industries(postings: DataFrame) -> DataFrame:
    """(company_key, industries): the sorted union of what the postings declare."""
    return postings.select("company_key", F.explode("li_industries").alias("i")).distinct().groupBy("company_key").agg(F.array_sort(F.collect_list("i")).alias("industries"))


def spelling_rows(listed: DataFrame, names: list[Column]) -> DataFrame:
    """(entry_id, norm) of every normalised spelling of a list."""
    return listed.select("entry_id", F.explode(F.concat(*names)).alias("norm")).where(F.col("norm") != "").distinct()


def exact_matches(names: DataFrame, spellings: DataFrame) -> DataFrame:
    """(norm, entry_id): names that are a spelling of the list; of several entries the first."""
    return names.join(spellings, "norm").groupBy("norm").agg(F.min("entry_id").alias("entry_id"))


def slug_matches(slugs: DataFrame, listed: DataFrame) -> DataFrame:
    known = listed.select("entry_id", F.explode("slugs").alias("slug")).select("entry_id", F.lower("slug").alias("slug"))
    return slugs.join(known, "slug").groupBy("slug").agg(F.min("entry_id").alias("entry_id"))


def subset_matches(names: DataFrame, listed: DataFrame) -> DataFrame:
    """(norm, entry_id): names that hold all tokens (two or more) of an entry, found through the entry's rarest token instead of comparing all with all."""
    entry = listed.where(F.size("tokens") >= 2).select("entry_id", "tokens")
    words = names.select("norm", F.explode(F.array_distinct(tokens(F.col("norm")))).alias("token"))
    frequency = words.groupBy("token").agg(F.count("*").alias("n"))
    rarest = entry.select("entry_id", "tokens", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    keyed = rarest.groupBy("entry_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("tokens").alias("tokens"))
    met = words.join(keyed, "token").where(F.size(F.array_except("tokens", tokens(F.col("norm")))) == 0)
    return met.groupBy("norm").agg(F.min("entry_id").alias("entry_id"))


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    out, matcher = [], SequenceMatcher()
    for x, y in zip(a, b, strict=True):
        if matcher.a != x:
            matcher.set_seq1(x)
        matcher.set_seq2(y)
        # shared letters in any order bound the likeness from above
        out.append(matcher.ratio() if matcher.quick_ratio() >= FUZZY_WEAK else 0.0)
    return pd.Series(out, dtype="float64")


def fuzzy_matches(names: DataFrame, spellings: DataFrame) -> DataFrame:
    """(norm, entry_id, ratio): the most similar entry of each name at FUZZY_WEAK or more, the first on ties.

    A likeness of 0.86 leaves at most 14 % of the letters unmatched, each of which spoils three trigrams at most, so two such names share a trigram:
    the join on trigrams loses nothing, and the ratio is computed for these pairs only.
    """
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))
    long = lambda df, c: df.where(F.length(c) >= LEAST_LETTERS)
    a = long(names.select("norm"), "norm").where(~((F.size(tokens(F.col("norm"))) == 1) & (F.length("norm") < 8)))
    b = long(spellings.select("entry_id", F.col("norm").alias("candidate")), "candidate")
    pairs = a.select("norm", F.explode(F.array_distinct(grams(F.col("norm")))).alias("g")).join(b.select("entry_id", "candidate", F.explode(F.array_distinct(grams(F.col("candidate")))).alias("g")), "g")
    la, lb = F.length("norm"), F.length("candidate")
    sized = pairs.where(2 * F.least(la, lb) >= FUZZY_WEAK * (la + lb))
    # each unmatched letter of either spoils three trigrams of the name at most: the others must be shared
    met = sized.groupBy("norm", "entry_id", "candidate").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.size(F.array_distinct(grams(F.col("norm")))) - 3 * (1 - FUZZY_WEAK) * (la + lb)).drop("shared")
    scored = met.withColumn("ratio", _likeness("norm", "candidate")).where(F.col("ratio") >= FUZZY_WEAK)
    return scored.groupBy("norm").agg(F.max_by("entry_id", F.struct("ratio", -F.col("entry_id"))).alias("entry_id"), F.max("ratio").alias("ratio"))


def phrase_scores(text: Column) -> dict[str, Column]:
    """Sum of each category's weight over its phrases in a normalised text, each phrase once."""
    out = {}
    for label, (weight, phrases) in PHRASES.items():
        out[label] = F.size(F.filter(literal_strings(p.replace(",", "").replace("-", " ") for p in phrases), lambda p: F.contains(text, p))) * weight
    return out


def first_in_list(values: Column, wanted: list[str]) -> Column:
    """The first of ``values`` that is in ``wanted``, null without one."""
    return F.try_element_at(F.filter(values, lambda x: F.array_contains(literal_strings(wanted), x)), F.lit(1))


def recency(days: Column, confidence: Column) -> Column:
    """Freshness of a posting between 0 and 1, drawn to the middle as its date is uncertain."""
    base = F.when(days.isNull(), 0.5).when(days <= 3, 1.0).when(days <= 7, 0.9).when(days <= 14, 0.7).when(days <= 30, 0.4).otherwise(0.15)
    return base * confidence + 0.5 * (1 - confidence)


def weighted(components: list[tuple[str, float, Column]]) -> tuple[Column, Column, Column]:
    """(score, two strongest, weakest) of named components (name, weight, value between 0 and 1), points rounded half to even.

    Strong are at most two components of value 0.6 or more by points; weak is the one that loses most, if its value is under a half.
    """
    items = F.array(*[F.struct(F.bround(F.lit(float(w)) * v, 2).alias("points"), F.lit(-i).alias("o"), F.lit(n).alias("name"), v.cast("double").alias("value"), (F.lit(float(w)) * (1 - v)).alias("loss")) for i, (n, w, v) in enumerate(components)])
    score = F.bround(F.aggregate(items, F.lit(0.0), lambda s, x: s + x["points"]), 1)
    strong = F.slice(F.reverse(F.array_sort(F.filter(items, lambda x: x["value"] >= 0.6))), 1, 2)
    worst = F.array_max(F.transform(items, lambda x: F.struct(x["loss"], x["o"], x["name"], x["value"])))
    return score, F.transform(strong, lambda x: x["name"]), F.when(worst["value"] < 0.5, worst["name"])


def ranked(companies: DataFrame, order: str) -> DataFrame:
    """Rank within the bucket: by newest posting then score, or by score; the key makes the order total."""
    by = [F.desc("score"), "company_key"] if order == "prioridad" else [F.desc_nulls_last("latest"), F.desc("score"), "company_key"]
    return companies.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy(*by)))


def facet_filter(df: DataFrame, chosen: dict[str, list[str]], most_days: int | None = None) -> DataFrame:
    """Rows that agree with every facet: one of its values is chosen; a facet without choice agrees."""
    for facet, values in chosen.items():
        if values:
            df = df.where(F.arrays_overlap(F.col(facet), literal_strings(values)))
    return df if most_days is None else df.where(F.col("days_min") <= most_days)


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of several array columns in one pass."""
    def of(facet: str) -> Column:
        return F.transform(F.array_distinct(facet), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    pairs = F.flatten(F.array(*map(of, facets)))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def identity(postings: DataFrame) -> DataFrame:
    """(company_key, display_name, aliases, logo, url, text_length): the most common spelling, the other ones, the first logo and address by ``seq``, the letters of all descriptions.

    Spellings are counted before they meet, so a company with many postings brings its distinct spellings only.
    """
    spelled = postings.where("company_name_raw is not null").groupBy("company_key", "company_name_raw").agg(F.count("*").alias("n"))
    names = spelled.groupBy("company_key").agg(F.max_by("company_name_raw", F.struct("n", "company_name_raw")).alias("display_name"), F.collect_list("company_name_raw").alias("all"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq")))
    facts = postings.groupBy("company_key").agg(first("company_logo_url").alias("logo"), first("company_linkedin_url").alias("url"), F.sum(F.length("description_text")).alias("text_length"))
    others = F.array_sort(F.filter("all", lambda x: x != F.col("display_name")))
    return facts.join(names, "company_key", "left").select("company_key", "display_name", F.when(F.size(others) > 0, others).alias("aliases"), "logo", "url", "text_length")


def in_order(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row within its key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def allowed(df: DataFrame, columns: set[str]) -> DataFrame:
    """Only the columns that may be shown: an allow-list never leaks a new column."""
    return df.select(*[c for c in df.columns if c in columns])
