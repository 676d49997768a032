"""Text normalisers as column expressions: everything stays in generated code, no Python per row."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose compatibility decompositions are folded: Latin, Latin additional, Roman numerals, ligatures, full width.
FOLDED_BLOCKS = ((0x80, 0x250), (0x1E00, 0x1F00), (0x2160, 0x2180), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))

#: Noise of job titles (gender marks, work mode, city, contract).
TITLE_NOISE = [
    r"\(\s*[mhfdxwv]\s*[/|]\s*[mhfdxwv]\s*([/|]\s*[mhfdxwv]\s*)?\)",
    r"\b[mhfdxwv]\s*[/|]\s*[mhfdxwv]\s*([/|]\s*[mhfdxwv])?\b",
    r"\((remoto|remote|hibrido|presencial|teletrabajo)\)",
    r"\b(remoto|remote|hibrido|hybrid|presencial|teletrabajo|onsite|on site)\b",
    r"\b(madrid|barcelona|valencia|sevilla|bilbao|malaga|espana|spain)\b",
    r"\b(full[ -]?time|part[ -]?time|jornada completa|media jornada)\b",
]
#: Words of level, left out of a title's core.
LEVEL_WORDS = (
    "junior jr senior sr snr lead principal staff becario becaria beca practicas trainee intern internship graduate entry level nivel inicial associate asociado asociada i ii iii iv"
).split()
#: Legal forms and the like at the end of a company's name.
LEGAL_SUFFIXES = [
    "sl", "slu", "s l", "s l u", "sa", "sau", "srl", "spa", "ltd", "limited", "llc", "inc", "plc", "gmbh", "ag", "bv", "nv", "oy", "ab", "sociedad limitada", "sociedad anonima",
    "holding", "holdings", "group", "grupo", "iberia", "espana", "spain", "emea", "europe", "international", "global",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for characters that fold to one character, and the pairs that fold to several, by rule from the Unicode database."""
    source, target, many = [], [], []
    for a, b in FOLDED_BLOCKS:
        for code in range(a, b):
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain == c or not plain or unicodedata.category(c) == "Cn":
                continue
            if len(plain) == 1:
                source.append(c)
                target.append(plain)
            elif plain.strip():
                many.append((c, plain))
    return "".join(source), "".join(target), tuple(many)


def strip_accents(c: Column | str) -> Column:
    """Accents off and compatibility forms folded; other scripts stay."""
    source, target, many = fold_tables()
    out = F.translate(col(c), source, target)
    marked = "[" + "".join(x for x, _ in many) + "]"
    several = out
    for x, plain in many:
        several = F.replace(several, F.lit(x), F.lit(plain))
    out = F.when(out.rlike(marked), several).otherwise(out)
    return F.regexp_replace(out, r"\p{M}+", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def folded(c: Column | str) -> Column:
    return F.lower(strip_accents(c))


def basic_norm(c: Column | str) -> Column:
    """Letters a-z and digits, single blanks between; an ampersand is "and"."""
    return F.trim(F.regexp_replace(F.replace(folded(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def normalize_text(c: Column | str) -> Column:
    """Folded text that keeps blanks, hyphens, plus signs and slashes."""
    return collapse(F.regexp_replace(folded(c), r"[^a-z0-9\s\-+/]", " "))


def _suffix_pattern(suffixes: list[str]) -> str:
    one = [" ?".join(s) for s in suffixes if " " not in s]
    return "|".join(sorted([*one, *(s for s in suffixes if " " in s)], key=lambda s: (-len(s), s)))


def company_norm(c: Column | str, suffixes: list[str] | None = None) -> Column:
    """Basic form without legal forms at its end; a name of nothing else stays."""
    name, alts = basic_norm(c), _suffix_pattern(suffixes or LEGAL_SUFFIXES)
    return F.when(name.rlike(f"^(?:{alts})(?: (?:{alts}))*$"), name).otherwise(F.regexp_replace(name, f"(?: (?:{alts}))+$", ""))


def tokens(c: Column) -> Column:
    """Words of a normalised text, none for the empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def is_short_single_token(norm: Column) -> Column:
    """One word of fewer than eight letters: too little to compare by likeness."""
    return (F.size(tokens(norm)) == 1) & (F.length(norm) < 8)


def normalize_title(c: Column | str) -> Column:
    """Title without gender forms, work mode, city and contract."""
    out = F.regexp_replace(folded(c), r"([a-z]{3,})\s*/\s*[ao]\b", "$1")
    for noise in TITLE_NOISE:
        out = F.regexp_replace(out, noise, " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def title_core(c: Column | str) -> Column:
    """Words of the normalised title without level words and single letters, sorted."""
    level = F.array(*map(F.lit, LEVEL_WORDS))
    kept = F.filter(F.split(normalize_title(c), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(level, w))
    return F.array_join(F.array_sort(kept), " ")


def monogram(c: Column | str) -> Column:
    """Initials of the first two words that start with a letter or digit; of one word its first two letters; "?" without any."""
    words = F.filter(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]"))
    n = F.size(words)
    return F.upper(F.when(n == 0, "?").when(n == 1, F.substring(F.element_at(words, 1), 1, 2)).otherwise(F.concat(F.substring(F.element_at(words, 1), 1, 1), F.substring(F.try_element_at(words, F.lit(2)), 1, 1))))


def upper_first(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substr(col(c), F.lit(2)))


def script_safe_json(c: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))
