"""Relative and absolute posting dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazario.functions.text import col

#: Unit (es, en) to days and confidence.
UNITS = {
    "segundo": (0.0, 1.0), "second": (0.0, 1.0), "minuto": (0.0, 1.0), "minute": (0.0, 1.0), "hora": (0.04, 1.0), "hour": (0.04, 1.0), "dia": (1.0, 1.0), "day": (1.0, 1.0),
    "semana": (7.0, 0.6), "week": (7.0, 0.6), "mes": (30.0, 0.3), "month": (30.0, 0.3), "ano": (365.0, 0.2), "year": (365.0, 0.2),
}
RELATIVE = r"(\d+)\s*(segundo|minuto|hora|dia|semana|mes|ano|second|minute|hour|day|week|month|year)"
JUST_NOW = r"\b(justo ahora|ahora mismo|just now|hoy|today|new|nuevo)\b"
#: Confidence of a text that says nothing.
UNKNOWN = 0.5


def _of_unit(unit: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), unit)


def relative_days(t: Column | str) -> Column:
    """Days before today that a folded text like "hace 2 semanas" means: the middle of the span for weeks and longer, half to even; null if unknown."""
    t = col(t)
    amount, unit = F.regexp_extract(t, RELATIVE, 1), F.regexp_extract(t, RELATIVE, 2)
    each = _of_unit(unit, {u: d for u, (d, _) in UNITS.items()})
    span = amount.try_cast("double") * each + F.when(each >= 7, each / 2).otherwise(0.0)
    return F.when(t.rlike(JUST_NOW), F.lit(0.0)).otherwise(F.bround(span, 0)).cast("int")


def relative_confidence(t: Column | str) -> Column:
    """How sure the date of a folded text is."""
    t = col(t)
    sure = _of_unit(F.regexp_extract(t, RELATIVE, 2), {u: c for u, (_, c) in UNITS.items()})
    return F.when(t.rlike(JUST_NOW), F.lit(1.0)).otherwise(F.coalesce(sure, F.lit(UNKNOWN)))


def iso_date(text: Column | str) -> Column:
    """The date of a strict ISO text, else null."""
    return F.when(col(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(text), "yyyy-MM-dd"))


def posted(text: Column | str, iso: Column | str, today: Column) -> tuple[Column, Column]:
    """(date, confidence): a valid ISO date is certain, else the folded relative text decides."""
    exact, days = iso_date(iso), relative_days(text)
    return F.coalesce(exact, F.date_sub(today, days)), F.when(exact.isNotNull(), F.lit(1.0)).otherwise(relative_confidence(text))


def days_since(date: Column | str, today: Column) -> Column:
    return F.datediff(today, col(date))
