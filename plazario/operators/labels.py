"""Level and role labels of job titles by ordered rules over normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazario.functions.text import folded, normalize_text, normalize_title
from plazario.operators.rules import any_hit, hits, ladder, verdict

# Patterns over folded text.
DESIGN = [
    r"\b(ux|ui|ux ?ui|ui ?ux)\b", r"\bproduct design(er)?\b", r"\bdise[nñ]ador[ae]?\b", r"\bdise[nñ]o\b", r"\bdesign(er)?\b", r"\binteraction design", r"\bvisual design", r"\bux (writer|research(er)?)\b",
    r"\bproducto digital\b", r"\bexperiencia de usuario\b", r"\binterfa[cz]", r"\bdise[nñ]o de producto\b", r"\busabilidad\b",
]
OTHER_DESIGN = [
    r"\bindustrial\b", r"\binterior(es|ismo)?\b", r"\btextil\b", r"\b(moda|fashion)\b", r"\bjoyer[ia]", r"\binstructional\b", r"\b(circuit|hardware|mecanic|pcb)\b", r"\bcad\b", r"\barquitectura tecnica\b", r"\bpaisaj",
]
SENIOR = [r"(?<![a-z])(sr|senior|snr)(?![a-z])", r"\bespecialista senior\b", r"\bexperto\b", r"(?<![a-z])(architect|arquitect[oa])(?![a-z])"]
LEAD = [r"(?<![a-z])(lead|leader|principal|staff)(?![a-z])", r"(?<![a-z])(head|chief|vp)(?![a-z])", r"(?<![a-z])(manager|mgr|director[ae]?)(?![a-z])", r"(?<![a-z])(jefe|jefa|responsable|coordinador[ae]?)(?![a-z])"]
ROMAN = [r"\b(II|III|IV)\b"]
JUNIOR = [
    r"(?<![a-z])(jr|junior)(?![a-z])", r"\bentry ?level\b", r"\bnivel inicial\b", r"\bbecari[oa]\b", r"\bbeca\b", r"\bpracticas\b", r"\b(internship)\b", r"(?<![a-z])intern(?![a-z])", r"\btrainee\b", r"\bgraduate\b",
    r"\brecien (graduad|titulad)[oa]\b", r"\baprendiz\b", r"\bprimer empleo\b", r"\bearly career\b",
]
WEAK_JUNIOR = [r"\bassociate\b", r"\basociad[oa]\b"]
TEXT_JUNIOR = [
    r"\b(0|1)\s*[-–a]\s*2\s*(anos|years)", r"\bmenos de 2 anos\b", r"\bhasta 2 anos\b", r"\bsin experiencia previa\b", r"\bno se requiere experiencia\b", r"\bprimer empleo\b", r"\bno experience required\b",
]
TEXT_SENIOR = [r"\b([5-9]|1[0-9])\s*\+?\s*(anos|years)", r"\bminimo (5|6|7|8|9|10) anos\b", r"\bat least (5|6|7|8|9|10) years\b"]
TEXT_MID = [r"\b[2-4]\s*[-–a]\s*[3-6]\s*(anos|years)", r"\b(3|4)\s*\+?\s*(anos|years)"]
AI_TEXT = [
    r"\b(ia|ai)\b", r"\bgen ?ai\b", r"\bllm\b", r"\binteligencia artificial\b", r"\bmachine learning\b", r"\baprendizaje automatico\b", r"\bcopilot\b", r"\bprompt", r"\bautomatizacion\b", r"\bfigma ai\b", r"\bdesign with ai\b",
    r"\bchatgpt\b", r"\bmidjourney\b",
]
ROLES = {
    "AI": [
        r"\bai\s+(product\s+)?design(er)?\b", r"\bdesign(er)?\s+.{0,12}\bai\b", r"\bdise[nñ]ador[ae]?\s+.{0,14}\b(ia|inteligencia artificial)\b", r"\bdise[nñ]o\s+.{0,14}\b(ia|inteligencia artificial)\b",
        r"\bprompt\s+(design(er)?|engineer)\b", r"\bconversational\s+design(er)?\b", r"\bdise[nñ]o conversacional\b", r"\bdesign technologist\b", r"\bgen ?ai design(er)?\b",
    ],
    "UXUI": [r"\bux\s*[/y+&-]?\s*ui\b", r"\bui\s*[/y+&-]?\s*ux\b"],
    "PRODUCT": [r"\bproduct design(er)?\b", r"\bdise[nñ]ador[ae]?\s+de\s+producto\b", r"\bdise[nñ]o de producto\b"],
    "UX": [r"\bux\b", r"\bexperiencia de usuario\b", r"\bux (writer|research(er)?)\b", r"\barquitectura de informacion\b", r"\binteraction design(er)?\b"],
    "UI": [r"\bui\b", r"\bvisual design(er)?\b", r"\bdise[nñ]ador[ae]?\s+de\s+interfa[cz]", r"\binterfa[cz]"],
}
FIELD_JUNIOR = ["practicas", "becari", "internship", "sin experiencia", "entry level", "nivel inicial"]


def with_level(df: DataFrame, title: str, description: str, field: str, name: str = "level") -> DataFrame:
    """``df`` with struct<label, confidence> of each posting's level; every text is normalised once, in a step of its own."""
    own = {"level title": normalize_title(title), "level text": normalize_text(description), "level field": folded(field)}
    normal = df.withColumns({k: F.coalesce(v, F.lit("")) for k, v in own.items()})
    return normal.withColumn(name, level(F.col(title), *map(F.col, own))).drop(*own)


def level(title: Column, t: Column, d: Column, f: Column) -> Column:
    """struct<label, confidence> by a title as it is and normalised title, description and field; NOT_DESIGN where the title is no design job."""
    senior = any_hit(t, SENIOR) | any_hit(F.coalesce(title, F.lit("")), ROMAN)
    junior = any_hit(t, JUNIOR)
    return ladder(
        [
            (~any_hit(t, DESIGN), verdict("NOT_DESIGN", 0.9)),
            (any_hit(t, OTHER_DESIGN), verdict("NOT_DESIGN", 0.9)),
            (any_hit(t, LEAD), verdict("LEAD", 0.95)),
            (senior & junior, verdict("SENIOR", 0.5)),
            (senior, verdict("SENIOR", 0.95)),
            (junior, verdict("JUNIOR", 0.95)),
            (any_hit(d, TEXT_SENIOR), verdict("SENIOR", 0.8)),
            (any_hit(d, TEXT_JUNIOR) | any_hit(f, FIELD_JUNIOR), verdict("JUNIOR_BY_DESC", 0.6)),
            (any_hit(d, TEXT_MID), verdict("MID", 0.7)),
            (any_hit(t, WEAK_JUNIOR), verdict("MID", 0.5)),
        ],
        verdict("MID", 0.4),
    )


def level_hits(title: Column) -> Column:
    """What in the title decides: hits of lead, senior and junior patterns in this order."""
    t = normalize_title(title)
    return F.concat(hits(t, LEAD), hits(t, SENIOR), hits(t, JUNIOR))


def role(title: Column) -> Column:
    """struct<label, second>: the role, and under AI the role it would have otherwise."""
    t = F.coalesce(folded(title), F.lit(""))
    base = ladder([(any_hit(t, ROLES[k]), F.lit(k)) for k in ("UXUI", "PRODUCT", "UX", "UI")], F.lit("OTRO"))
    ai = any_hit(t, ROLES["AI"])
    return F.struct(F.when(ai, "AI").otherwise(base).alias("label"), F.when(ai & (base != "OTRO"), base).alias("second"))


def ai_mentions(title: Column, description: Column) -> Column:
    """Number of distinct things about artificial intelligence that the posting's text says."""
    text = normalize_text(F.concat_ws("\n", title, description))
    return F.size(F.array_distinct(hits(text, AI_TEXT)))
