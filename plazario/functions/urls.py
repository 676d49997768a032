"""URLs of postings and companies, their keys and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazario.functions.text import col

SLUG = r"^[a-z0-9][a-z0-9-]{0,98}[a-z0-9]$"
#: Verdicts of a link check.
OK, DEAD, REDIRECTED, BLOCKED, NO_ANSWER = "ok", "muerto", "redirigido", "bloqueado", "sin respuesta"
#: Codes that say nothing about the link.
BLOCKING_CODES = (403, 429, 999)


def strip_query(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"[?#].*$", "")


def company_slug(url: Column | str) -> Column:
    """What follows /company/, without query and closing slash; null without it."""
    return F.nullif(F.regexp_extract(col(url), r"/company/([^?#]*?)/*(?:[?#].*)?$", 1), F.lit(""))


def job_url(base: str, job_id: Column | str) -> Column:
    return F.concat(F.lit(base + "/jobs/view/"), col(job_id), F.lit("/"))


def valid_slug(slug: Column | str) -> Column:
    """The slug in lower case without slashes at its ends, null if it cannot be one."""
    s = F.lower(F.trim(F.trim(F.coalesce(col(slug), F.lit(""))), F.lit("/")))
    return F.when(s.rlike(SLUG), s)


def company_jobs_url(base: str, slug: Column | str) -> Column:
    return F.concat(F.lit(base + "/company/"), valid_slug(slug), F.lit("/jobs/"))


def search_url(base: str, parameters: list[tuple[str, Column]]) -> Column:
    """``base`` with URL-encoded parameters; null ones are left out."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in parameters]))


def url_key(url: Column | str) -> Column:
    return F.sha1(col(url))


def favicon_url(base: str, domain: Column | str) -> Column:
    """Icon address of a domain, null for a blank one."""
    d = F.ltrim(F.trim(col(domain)), F.lit("@"))
    return F.when(d != "", F.concat(F.lit(base), d))


def link_verdict(url: Column | str, code: Column | str, final: Column | str) -> Column:
    """Verdict of an answered (or unanswered) request; a 200 that lost the company's slug is a redirect."""
    code, at = col(code), F.coalesce(F.nullif(col(final), F.lit("")), col(url))
    slug = F.regexp_extract(col(url), "/company/([^/?#]+)", 1)
    return (
        F.when(code.isNull(), NO_ANSWER)
        .when(code.isin(*BLOCKING_CODES), BLOCKED)
        .when(code >= 400, DEAD)
        .when(at.contains("/login") | at.contains("authwall"), BLOCKED)
        .when((slug != "") & ~at.contains(F.concat(F.lit("/company/"), slug)), REDIRECTED)
        .otherwise(OK)
    )
