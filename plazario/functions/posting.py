"""Derived fields of a posting: keys, place bucket, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazario.common import blank_to_null
from plazario.functions.text import basic_norm, col, company_norm, folded, title_core
from plazario.functions.urls import company_slug

MADRID, REMOTE_ES, REST_ES, OUTSIDE_ES, UNKNOWN = "MADRID", "REMOTE_ES", "REST_ES", "OUTSIDE_ES", "UNKNOWN"
#: What a place's text is searched for.
MADRID_MARKS = ["madrid", "alcobendas", "las rozas", "pozuelo", "tres cantos", "getafe", "alcala de henares", "san sebastian de los reyes", "leganes", "mostoles", "boadilla", "majadahonda", "coslada"]
SPAIN_MARKS = ["espana", "spain", "madrid", "barcelona", "valencia", "sevilla", "malaga", "bilbao", "zaragoza", "murcia", "palma", "alicante", "vigo", "gijon", "coruna", "valladolid", "granada", "santander"]
REMOTE_MARKS = ["remote", "remoto", "teletrabajo"]
#: Captions of labels and the key a filter uses for them.
LEVEL_CAPTIONS = {"JUNIOR": "Junior", "JUNIOR_BY_DESC": "Junior (descripción)", "MID": "Intermedio", "SENIOR": "Senior", "LEAD": "Lead", "NOT_DESIGN": "No es diseño"}


def contains_any(text: Column, marks: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(marks)), F.lit(False))


def location_bucket(location: Column | str, workplace: Column | str) -> Column:
    """Bucket of a place as typed: Madrid before remote, remote within Spain (or nowhere), the rest of Spain, elsewhere, unknown."""
    place, mode = F.coalesce(basic_norm(location), F.lit("")), F.coalesce(basic_norm(workplace), F.lit(""))
    remote = contains_any(place, REMOTE_MARKS) | contains_any(mode, REMOTE_MARKS)
    spain = contains_any(place, SPAIN_MARKS)
    return F.when(contains_any(place, MADRID_MARKS), MADRID).when(remote & (spain | (place == "")), REMOTE_ES).when(spain, REST_ES).when(place != "", OUTSIDE_ES).otherwise(UNKNOWN)


def company_key(url: Column | str, name: Column | str) -> Column:
    """First of the URL's slug, the normalised name, the lower-case name that is not empty."""
    return F.coalesce(company_slug(url), F.nullif(company_norm(name), F.lit("")), F.lower(col(name)))


def haystack(title: Column | str, description: Column | str) -> Column:
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.coalesce(col(description), F.lit("")))


def dedupe_key(key: Column | str, title: Column | str, bucket: Column | str) -> Column:
    """Sixteen hex digits that reposts of one job in one place share."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (col(key), title_core(title), col(bucket))])), 1, 16)


def caption(label: Column | str, captions: dict[str, str]) -> Column:
    """Caption of a label, the label itself if it has none."""
    out = col(label)
    for k, v in captions.items():
        out = F.when(col(label) == k, F.lit(v)).otherwise(out)
    return out


def filter_key(level: Column | str) -> Column:
    """Key of a level in a filter: both kinds of junior are one."""
    return F.lower(F.when(col(level) == "JUNIOR_BY_DESC", "JUNIOR").otherwise(col(level)))


def days_caption(days: Column | str) -> Column:
    return F.concat(col(days).cast("string"), F.when(col(days) == 1, " día").otherwise(" días"))


def bind(raw, today: Column):
    """Raw records as postings: one projection, everything derived from the record itself."""
    from plazario.functions.dates import posted

    date, sure = posted("posted_folded", "posted_iso", today)
    keyed = raw.withColumn("posted_folded", folded("posted_text")).withColumns({"company_key": company_key("company_url", "company"), "location_bucket": location_bucket("location", "workplace_type"), "posted_at": date, "posted_confidence": sure})
    return keyed.withColumns({"dedupe_key": dedupe_key("company_key", "title", "location_bucket"), "slug": company_slug("company_url"), "title_known": blank_to_null("title").isNotNull()})
