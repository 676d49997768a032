"""Sinks of a run: tables, and a page of the small company table."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from plazario.common import bounded

#: Columns that may be published.
PUBLIC = {"company_key", "display_name", "n_jobs", "latest", "buckets", "levels", "roles", "score", "rank", "bucket"}


def write_tables(run, folder: str) -> None:
    run.postings.write.mode("overwrite").parquet(f"{folder}/postings")
    run.filtered.write.mode("overwrite").parquet(f"{folder}/filtered")
    run.companies.write.mode("overwrite").parquet(f"{folder}/companies")


def page(companies: DataFrame, title: str, public: bool = True, most: int = 10_000) -> str:
    """A table of companies by bucket and rank; refuses a table too long for a page."""
    columns = [c for c in companies.columns if not public or c in PUBLIC]
    rows = bounded(companies.orderBy("bucket", "rank").select(*columns), most, "companies of a page")

    def cell(v) -> str:
        return escape(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v))

    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
