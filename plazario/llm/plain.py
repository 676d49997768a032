"""One consistent form for text that looks the same (compiled longest-match transducer).

The mapping is built once, by rule, from the Unicode database: full and half width to ordinary width, every kind of blank to the ordinary space, hyphen variants to the hyphen, ligatures and
single-character numerals to ordinary letters and digits, invisible characters to nothing, and clusters of a character, in any of these forms, and marks to the composed letter.  Keys are checked for
conflicts (two results for one key, two keys that compete for a character, a result that would be rewritten again) and compiled into a trie whose longest match is taken at every place, so
a text is rewritten in one pass.  Look-alike letters depend on the word they stand in: the same pass collects the scripts of the word and maps the minority's look-alikes when it ends.

Defined results: null stays null; an empty text stays empty; a text of invisible characters only becomes empty; a word wholly in
one script, dashes, middle dots and doubled ordinary spaces stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts drawn like a Latin letter, written as pairs (look-alike, Latin).
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl вв АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW Ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi κk ρp υu αa γy ηn τt χx "
    "ᎪA ᎠD ᎬE ᎢT ᎫJ ᎷM ᏀG ᏃZ ᏚS ᏟC ᏢP ᏦK ᏴB ᎳW ᏙV ᏞL ᏒR ᎻH ᎥI "
    "ՍU ՏS ՕO օo սu հh ոn ցg զq ԼL кk мm тt нh"
)
_INVISIBLE_MARKS = "͏ᅟᅠ឴឵ㅤﾠ᠎"
_HYPHENS = "‐‑﹣⁃"
_FRACTION = "⁄"


def _lookalike_map() -> dict[str, str]:
    pairs = {}
    for p in LOOKALIKES.split():
        if p[0] == p[1] or ord(p[1]) > 127:
            continue
        if pairs.setdefault(p[0], p[1]) != p[1]:
            raise ValueError(f"two results for {p[0]!r}")
    return pairs


@cache
def single_map() -> dict[str, str]:
    """Character to plain text, by rule, for every character whose form alone is not plain."""
    out: dict[str, str] = {}
    ranges = [(0x80, 0x3400), (0xA000, 0xA830), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F1AD), (0xE0000, 0xE0200)]
    for a, b in ranges:
        for code in range(a, b):
            c = chr(code)
            kind = unicodedata.category(c)
            form = unicodedata.decomposition(c).split(" ")[0] if unicodedata.decomposition(c).startswith("<") else ""
            if kind == "Cf" or c in _INVISIBLE_MARKS or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code < 0xE0200:
                out[c] = ""
            elif kind in ("Zs", "Zl", "Zp"):
                out[c] = " "
            elif c in _HYPHENS:
                out[c] = "-"
            elif form in ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<fraction>") or form == "<compat>" and (kind[0] in "LN" or 0x2100 <= code < 0x2150 or 0x2460 <= code < 0x2500):
                out[c] = unicodedata.normalize("NFKC", c).replace(_FRACTION, "/")
            elif form == "<super>" and kind == "No" or form == "<sub>" and kind == "No":
                out[c] = unicodedata.normalize("NFKC", c)
    for c in "\t\n\r\x0b\x0c\x85µ":
        out.pop(c, None)
    # a result must itself be plain, else one pass is not enough
    for c, r in list(out.items()):
        while any(x in out for x in r):
            r = "".join(out.get(x, x) for x in r)
        out[c] = r.strip() if c not in r and out[c] != " " else r
    return out


def compositions() -> dict[tuple[str, str], str]:
    """Letter and mark (or two parts of a Korean syllable) to the letter they compose, by rule from the Unicode database."""
    out = {}
    for code in (*range(0x80, 0x3400), *range(0xFB1D, 0xFB50), *range(0x11000, 0x11A00)):
        c = chr(code)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts:
            a, b = (chr(int(x, 16)) for x in parts.split())
            if unicodedata.normalize("NFC", a + b) == c:
                out[a, b] = c
    for lead in range(0x1100, 0x1113):
        for vowel in range(0x1161, 0x1176):
            syllable = chr(0xAC00 + ((lead - 0x1100) * 21 + vowel - 0x1161) * 28)
            out[chr(lead), chr(vowel)] = syllable
            for tail in range(0x11A8, 0x11C3):
                out[syllable, chr(tail)] = chr(ord(syllable) + tail - 0x11A7)
    return out


def mapping() -> dict[str, str]:
    """Every key of the transducer: single characters, characters that Unicode writes in another way, and clusters of a character, in any of its forms, and marks that compose with it."""
    out = dict(single_map())
    for a, b in ((0x80, 0x3400), (0xF900, 0xFE00), (0x1D100, 0x1D200), (0x2F800, 0x2FA20)):
        for code in range(a, b):
            if chr(code) not in out and (c := unicodedata.normalize("NFC", chr(code))) != chr(code):
                out[chr(code)] = c
    after: dict[str, list[tuple[str, str]]] = {}
    pairs = compositions()
    for (a, b), c in pairs.items():
        after.setdefault(a, []).append((b, c))
    for (a, _), c in pairs.items():  # marks in another order than Unicode's
        for mark, _ in after[a] if a < "\u1100" else ():
            if (c, mark) not in pairs and len(r := unicodedata.normalize("NFC", c + mark)) == 1:
                after.setdefault(c, []).append((mark, r))
    marks = {}
    for c, plain_form in out.items():
        if len(plain_form) == 1:
            marks.setdefault(plain_form, []).append(c)

    def add(key: str, result: str) -> None:
        # each mark in each of its forms; results that compose further in turn
        for mark, composed in after.get(result[-1:], ()):
            composed = out.get(composed, composed)
            for form in (mark, *(() if "\u1100" <= mark < "\u1200" else marks.get(mark, ()))):
                longer = key + form
                if out.setdefault(longer, result[:-1] + composed) != result[:-1] + composed:
                    raise ValueError(f"two results for {longer!r}")
                add(longer, result[:-1] + composed)

    for c, r in [*out.items(), *((c, c) for c in after if c not in out)]:
        if len(c) == 1 and not (c != r and "\u1100" <= r < "\u1200"):
            add(c, r)
    return out


class Trie:
    """Longest match over code points; a node is a dict, its result sits under the empty string.

    Characters that map to nothing are stepped over inside a key, so a mark finds its letter across them.
    """

    def __init__(self, keys: dict[str, str]):
        self.root: dict = {}
        self.nothing = frozenset(k for k, r in keys.items() if not r and len(k) == 1)
        for key, value in keys.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            if node.setdefault("", value) != value:
                raise ValueError(f"two results for {key!r}")
        self._check(keys)

    def _check(self, keys: dict[str, str]) -> None:
        """No two keys may compete for a character, and no result may be rewritten again."""
        begin = {k[0] for k in keys if len(k) > 1}
        for k in keys:
            if not begin.isdisjoint(k[1:]):
                raise ValueError(f"{k!r} overlaps the beginning of another key")
        for k, r in keys.items():
            at = 0
            while at < len(r):
                hit = self.match(r, at)
                if hit is not None and r[at : hit[0]] != hit[1]:
                    raise ValueError(f"the result of {k!r} is rewritten again")
                at = hit[0] if hit else at + 1

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        """End and result of the longest key at a place."""
        node, best, i = self.root, None, at
        while i < len(text):
            below = node.get(text[i])
            if below is None:
                if i > at and text[i] in self.nothing:
                    i += 1
                    continue
                break
            node = below
            i += 1
            if "" in node:
                best = i, node[""]
        return best


@cache
def transducer() -> Trie:
    return Trie(mapping())


#: Texts of these characters only are plain already.
_FAST = regex.compile(r"[\x20-\x7E¡-¬®-±´-¸º»¿-ıĴ-ľŁ-ňŊ-ž–—\n\r\t]*")
_SCRIPTS = (("Latn", regex.compile(r"\p{Latin}")), ("Cyrl", regex.compile(r"\p{Cyrillic}")), ("Grek", regex.compile(r"\p{Greek}")), ("Cher", regex.compile(r"\p{Cherokee}")), ("Armn", regex.compile(r"\p{Armenian}")), ("othr", regex.compile(r"\p{L}")))


@cache
def script(c: str) -> str:
    """Script of a letter; empty for anything else.  Japanese and other rarer scripts count as one."""
    if not c.isalpha() or c in "ªº":
        return ""
    return next((name for name, p in _SCRIPTS if p.match(c)), "")


@cache
def lookalikes() -> dict[str, dict[str, str]]:
    """Script to the map from other scripts' letters into it."""
    to_latin = _lookalike_map()
    maps: dict[str, dict[str, str]] = {"Latn": dict(to_latin)}
    for other, latin in to_latin.items():
        maps.setdefault(script(other), {}).setdefault(latin, other)
    return maps


def _word(letters: list[str]) -> tuple[str, bool]:
    """A word in one script where look-alikes allow it, the script of most of its letters first (Latin on a tie), else as it is; and whether it still mixes scripts."""
    count: dict[str, int] = {}
    for c in letters:
        if s := script(c):
            count[s] = count.get(s, 0) + 1
    if len(count) < 2:
        return "".join(letters), False
    maps = lookalikes()
    order = sorted(count, key=lambda s: (-count[s], s != "Latn"))
    for target in order:
        table = maps.get(target, {})
        if all(script(c) in ("", target) or c in table for c in letters):
            return "".join(c if script(c) in ("", target) else table[c] for c in letters), False
    return "".join(letters), True


@cache
def _in_word(c: str) -> bool:
    return c.isalpha() or c.isdigit() or unicodedata.category(c)[0] == "M"


def rewritten(text: str) -> tuple[str, bool]:
    """The plain form of a text and whether a word of it mixes scripts that no look-alike resolves, in one pass."""
    match, out, word, at, mixed = transducer().match, [], [], 0, False
    while at < len(text):
        hit = match(text, at)
        at, piece = hit if hit else (at + 1, text[at])
        for c in piece:
            if _in_word(c):
                word.append(c)
            else:
                if word:
                    done, unsolved = _word(word)
                    out.append(done)
                    mixed |= unsolved
                    word = []
                out.append(c)
    done, unsolved = _word(word)
    return "".join([*out, done]), mixed | unsolved


def plain(text: str | None) -> str | None:
    """The plain form of a text."""
    return text if text is None or _FAST.fullmatch(text) else rewritten(text)[0]


@F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("mixed", T.BooleanType())]))
def _rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        done = [(None, None) if t is None else rewritten(t) for t in s]
        yield pd.DataFrame({"plain": [p for p, _ in done], "mixed": [m for _, m in done]})


@F.pandas_udf(T.StringType())
def _plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(plain, na_action="ignore")


#: Java pattern of the texts that are plain for certain and need not leave the JVM.
_ORDINARY = r"^[\x20-\x7E¡-¬®-±´-¸º»¿-ıĴ-ľŁ-ňŊ-ž–—\n\r\t]*$"


def needs_look(c: Column | str) -> Column:
    """Whether a text holds any character that could make it other than plain."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~c.rlike(_ORDINARY)


def plain_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_plain`` beside each column.

    A value that cannot differ passes as it is: only the others are sent to Python, as null-free rows of one batch.
    """
    sent = {c: F.when(needs_look(c), F.col(c)) for c in columns}
    return df.withColumns({f"{c}_plain": F.coalesce(_plain(sent[c]), F.col(c)) for c in columns})


def not_plain(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, raw, plain): the values of ``columns`` that are not plain.

    These are the values whose plain form differs, and those with a word of several scripts that no look-alike resolves.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("raw")) for c in columns])
    rows = df.select(F.col(key), F.explode(fields).alias("f")).select(key, "f.field_name", "f.raw").where(needs_look("raw"))
    done = rows.withColumn("done", _rewritten("raw")).select(key, "field_name", "raw", "done.plain", "done.mixed")
    return done.where((F.col("raw") != F.col("plain")) | F.col("mixed")).drop("mixed")
