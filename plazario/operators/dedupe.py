"""Reposts merged into one posting with an auditable history.

Two forms.  ``merge`` orders the rows of a group by (dated, posted_at, session before guest, length of the text, earlier seq) and aggregates: partial
aggregation on the map side, any group size.  ``fold`` applies the pairwise preference row by row in order of arrival, which differs only where some rows of a
group have no date (the pairwise rule is not transitive there); it holds a group in one row and is meant for groups of bounded size.
Rows of a blank or null key are not merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazario.common import blank_to_null

#: Columns a merged posting takes from others where its own are empty.
BACKFILLED = ("description_text", "li_industries", "li_seniority_field", "company_linkedin_url")
#: Likeness at which two titles of one company and place are one.
FUZZY_TITLE = 0.90


def preference(seq: str = "seq") -> Column:
    """Total order of preference, largest first."""
    return F.struct(
        F.col("posted_at").isNotNull().alias("dated"), F.coalesce("posted_at", F.lit("0001-01-01").cast("date")).alias("at"), (F.col("source") == "session").alias("own"),
        F.length(F.coalesce("description_text", F.lit(""))).alias("length"), (-F.col(seq)).alias("early"),
    )


def _filled(name: str, dtype: str) -> Column:
    return F.size(name) > 0 if dtype.startswith("array") else blank_to_null(name).isNotNull()


def merge(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: the preferred row, sightings summed, identifiers of the others in ``merged_ids``, empty fields filled from the next best."""
    keyed = df.where(blank_to_null(key).isNotNull())
    order, kinds = preference(), dict(df.dtypes)
    fixed = [c for c in df.columns if c not in (key, "n_sightings", "merged_ids", *BACKFILLED)]
    others = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("merged_ids", F.array().cast("array<string>")), F.col("job_id"))))))
    aggs = [F.max_by(c, order).alias(c) for c in fixed]
    aggs += [F.max_by(F.when(_filled(c, kinds[c]), F.col(c)), F.when(_filled(c, kinds[c]), order)).alias(c) for c in BACKFILLED if c in df.columns and c != key]
    merged = keyed.groupBy(key).agg(*aggs, F.sum("n_sightings").alias("n_sightings"), others.alias("all_ids"), F.count("*").alias("n_rows"))
    own = F.col("job_id")
    merged = merged.withColumn("merged_ids", F.when((F.col("n_rows") > 1) & (F.lit(key) == "job_id"), F.col("all_ids")).otherwise(F.array_remove("all_ids", own)))
    rest = df.where(blank_to_null(key).isNull())
    return merged.select(*df.columns).unionByName(rest)


def _preferred(a: Column, b: Column) -> Column:
    """Whether ``a``, the earlier, stays."""
    both = a["posted_at"].isNotNull() & b["posted_at"].isNotNull() & (a["posted_at"] != b["posted_at"])
    sourced = F.when(a["source"] != b["source"], a["source"] == "session").otherwise(a["length"] >= b["length"])
    return F.when(both, a["posted_at"] > b["posted_at"]).otherwise(sourced)


def fold(df: DataFrame, key: str) -> DataFrame:
    """(key, job_id, merged_ids, n_sightings) after the pairwise fold in order of ``seq``.

    Of a text only its length decides, and whether it fills an empty one, so no text moves.
    """
    length = F.length(F.coalesce("description_text", F.lit("")))
    item = F.struct("seq", "job_id", "posted_at", "source", length.alias("length"), F.coalesce("merged_ids", F.array().cast("array<string>")).alias("merged_ids"), F.col("n_sightings").cast("bigint").alias("n_sightings"))
    rows = df.where(blank_to_null(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def joined(w: Column, loser: Column) -> Column:
        ids = F.array_sort(F.array_distinct(F.concat(w["merged_ids"], F.array(loser["job_id"]), loser["merged_ids"])))
        return F.struct(w["seq"].alias("seq"), w["job_id"].alias("job_id"), w["posted_at"].alias("posted_at"), w["source"].alias("source"), F.when(w["length"] > 0, w["length"]).otherwise(loser["length"]).alias("length"), ids.alias("merged_ids"), (w["n_sightings"] + loser["n_sightings"]).alias("n_sightings"))

    merged = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.element_at("rows", 1), lambda a, b: F.when(_preferred(a, b), joined(a, b)).otherwise(joined(b, a)))
    return rows.withColumn("w", merged).select(key, "w.job_id", "w.merged_ids", "w.n_sightings")


def title_groups(df: DataFrame, company: str, place: str, title: str) -> DataFrame:
    """(company, place, title, title_group): titles of one company and place grouped greedily by likeness.

    Works on distinct titles, however many rows carry them; a title joins the first group, in order of first arrival, whose representative is like it.
    """
    distinct = df.where(F.col(title) != "").groupBy(company, place, title).agg(F.min("seq").alias("first"))
    whole = distinct.groupBy(company, place).agg(F.array_sort(F.collect_list(F.struct("first", title))).alias("titles")).select(company, place, F.col(f"titles.{title}").alias("titles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, titles in enumerate(b.column(2).to_pylist()):
                found = [titles] if len(titles) < 2 else [titles, grouped_titles(titles)]
                ends = [pa.array([b.column(c)[k].as_py()] * len(titles), pa.string()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(found[0], pa.string()), pa.array(found[-1], pa.string())], [company, place, title, "title_group"])

    return whole.mapInArrow(run, f"`{company}` string, `{place}` string, `{title}` string, title_group string")


#: Letters are told apart by their code in so many classes.
_LETTERS = 40


class Heads:
    """Representatives of one company and place, by length, with the letters of each counted: likeness is bounded before it is computed."""

    def __init__(self):
        self.by_length: dict[int, tuple[list[tuple[int, str]], np.ndarray]] = {}
        self.n = 0

    def add(self, title: str) -> None:
        heads, letters = self.by_length.get(len(title), ([], np.empty((8, _LETTERS), np.uint8)))
        if len(heads) == len(letters):
            letters = np.concatenate([letters, np.empty_like(letters)])
        letters[len(heads)] = counted_letters(title)
        heads.append((self.n, title))
        self.by_length[len(title)] = heads, letters
        self.n += 1

    def like(self, title: str) -> str | None:
        """The first representative that is like ``title``."""
        n, own, near = len(title), counted_letters(title), []
        for length, (heads, letters) in self.by_length.items():
            # the common letters are at most those of the shorter one, and those of either
            if 2.0 * min(length, n) / (length + n) >= FUZZY_TITLE:
                # what a byte does not count is not told apart
                common = np.full(len(heads), length + n) if max(length, n) > 255 else np.minimum(letters[: len(heads)], own).sum(axis=1, dtype=np.int64)
                near += [heads[k] for k in np.flatnonzero(2.0 * common / (length + n) >= FUZZY_TITLE).tolist()]
        return next((h for _, h in sorted(near) if _subsequence(h, title) >= FUZZY_TITLE and SequenceMatcher(None, h, title).ratio() >= FUZZY_TITLE), None)


def counted_letters(title: str) -> np.ndarray:
    """How often each class of letters occurs, for titles of no more letters than a byte counts."""
    return np.bincount(np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS, minlength=_LETTERS).astype(np.uint8)


def _subsequence(a: str, b: str) -> float:
    """Likeness that the longest common subsequence gives; the matching blocks of SequenceMatcher are one, so theirs is no larger."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        both = row & at.get(c, 0)
        row = (row + both | row - both) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def grouped_titles(titles: list[str]) -> list[str]:
    """For each title, in order of first arrival, the first representative like it, else itself."""
    heads, out = Heads(), []
    for t in titles:
        best = heads.like(t)
        if best is None:
            heads.add(t)
        out.append(t if best is None else best)
    return out


def repost_groups(df: DataFrame) -> DataFrame:
    """(arrival, repost): for rows of one company and bucket, the arrival of the first row of the repost group each belongs to, as text; groups of one are left out.

    ``df`` has one row for each ``arrival`` and ``core``.  In order of arrival a row joins the first group whose representative's core is like its own; the representative
    is replaced by the preferred of the two.  Only narrow rows of companies with several postings in a bucket move, but those of one company and bucket meet in one task.
    """
    place = ["company_key", "location_bucket"]
    narrow = df.where("company_key is not null").select(*place, "arrival", "core", F.datediff("posted_at", F.lit("1970-01-01").cast("date")).cast("double").alias("day"), (F.col("source") == "session").alias("own"), F.length(F.coalesce("description_text", F.lit(""))).alias("length"))
    several = narrow.join(narrow.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").drop("n"), place, "left_semi")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[list] = []
        of: dict[int, int] = {}
        match = SequenceMatcher()
        for arrival, core, day, own, length in pdf.sort_values("arrival")[["arrival", "core", "day", "own", "length"]].itertuples(index=False):
            match.set_seq2(core)
            for h in heads:
                match.set_seq1(h[1])
                # the quick ratios are upper bounds
                if match.real_quick_ratio() >= FUZZY_TITLE and match.quick_ratio() >= FUZZY_TITLE and SequenceMatcher(None, h[1], core).ratio() >= FUZZY_TITLE:
                    of[arrival] = h[0]
                    dated = day == day and h[2] == h[2] and day != h[2]
                    stays = h[2] > day if dated else h[3] if h[3] != own else h[4] >= length
                    if not stays:
                        h[1:] = [core, day, own, length or h[4]]
                    else:
                        h[4] = h[4] or length
                    break
            else:
                heads.append([arrival, core, day, own, length])
        joined = set(of.values())
        rows = [*of.items(), *((h, h) for h in joined)]
        return pd.DataFrame({"arrival": pd.Series([a for a, _ in rows], dtype="int64"), "repost": pd.Series([str(h) for _, h in rows], dtype="object")})

    return several.groupBy(*place).applyInPandas(group, "arrival bigint, repost string")


def alias_suspicions(df: DataFrame, norm: str, key: str, name: str) -> DataFrame:
    """Normalised names under which several companies appear: (norm, keys, name as last seen)."""
    return df.where(F.col(norm) != "").groupBy(norm).agg(F.array_sort(F.collect_set(key)).alias("company_keys"), F.max_by(name, "seq").alias("name")).where(F.size("company_keys") > 1)


def reconcile(n_seen: DataFrame, n_kept: DataFrame, n_filtered: DataFrame, n_merged: DataFrame) -> DataFrame:
    """One row (seen, kept, filtered, merged, balanced): every posting leaves by exactly one route."""
    one = n_seen.toDF("seen").join(n_kept.toDF("kept")).join(n_filtered.toDF("filtered")).join(n_merged.toDF("merged"))
    return one.withColumn("balanced", F.col("seen") == F.col("kept") + F.col("filtered") + F.col("merged"))
