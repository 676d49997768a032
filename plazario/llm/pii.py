"""Personal information in free text found by a semi-Markov conditional random field.

Generous patterns propose candidate segments (character spans of bounded length) of five kinds; a segment has a score from features of
the whole span and of the words around it; a dynamic programme over the segments of a text chooses boundaries and kinds jointly, as the best set of
segments that do not overlap.  The weights maximise the conditional likelihood of the marked sentences in ``pii_examples`` (forward-backward
over the same segments); training takes a moment on the driver and the weights, some hundred numbers, are broadcast.

Names of persons need to know names.  A given list is only a beginning: the lexicon grows by counting, over all texts, the capitalised words that stand
beside known names with several different partners, and there in a good part of all their places, and are not also written in lower case.  It grows until no word is added; a round that
would add more than MOST_NAMES is refused.

Defined results: null, empty and blank texts have no items; texts of any length are read whole; repeated items come out once for every place.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazario.common import bounded, durable, spread
from plazario.llm import shingles as S
from plazario.llm.pii_examples import EXAMPLES

KINDS = ("email", "phone", "ident", "address", "name")
#: Words that a round may add to the name lexicon (more are refused, none is left out); what a word needs: partners, share of capitals, share of its places beside a known name.
MOST_NAMES, LEAST_PARTNERS, LEAST_CAPITAL, LEAST_BESIDE = 1_000_000, 2, 0.9, 0.3
#: Rows that a list of names may have.
MOST_LISTED = 200_000
#: Longest name candidate in words.
MOST_WORDS = 6

_U, _L = r"\p{Lu}", r"[\p{Ll}\p{M}'’]"
_W = rf"(?:{_U}{_L}+(?:-{_U}{_L}+)*|{_U}{{2,}}(?:-{_U}{{2,}})*)"
_AT = r"(?:\s?@\s?|\s*[\[({<]\s*(?:at|arroba|a)\s*[\])}>]\s*|\s+(?:arroba|at)\s+(?=[\w-]+(?:\s+(?:dot|punto)\s+|\s*[\[(])))"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|punto|point|punkt|ponto)\s*[\])}>]\s*|\s+(?:dot|punto)\s+)"
_NUM = r"(?:,?\s*(?:n\.?\s?[ºo°]\.?|núm\.?|no\.|nr\.?)?\s*\d{1,4}(?:\s?(?:bis|ter)\b|[A-Za-z]\b(?![.'’])|\s[B-Z]\b(?![.'’]))?)"
_NAMEWORDS = rf"(?:(?:de|del|la|las|los|el|da|do|das|dos|du|des|d['’]|l['’]|le|les|y|e|von|der|den|am|an|a|o)\s*)*(?:{_U}[\w'’.-]*\s*|\s*(?:de|del|la|las|los|da|do|das|dos|du|des|y|en)\s+)+?"
_ROAD_BEFORE = r"(?i:calle|c/|avenida|avda\.?|av\.|paseo|p\.º|pº|plaza|pza\.?|pl\.|ronda|camino|cno\.|carretera|ctra\.?|travesía|trav\.|glorieta|pasaje|callejón|rua|r\.|travessa|tv\.|largo|praça|alameda|urbanización|carrer|avinguda|plaça|passeig)"
_ROAD_AFTER = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Close|Cl\.|Avenue|Ave\.?|Drive|Dr\.|Court|Ct\.|Terrace|Square|Sq\.|Way|Place|Crescent|Gardens|Grove|Row|Mews|Hill|STREET|ROAD|LANE|CLOSE)"
_FLOOR = r"(?:\s?,?\s*(?:-\s*)?(?:\d{1,2}\.?\s?[ºª°]\s?(?:[A-Za-z]\b|(?:dcha|izda|esq|dto)\b\.?)?|bajo(?:\s(?:dcha|izda)\.?|\b)|r/c|ático)(?!\w))?"

#: Proposals by kind; each keeps every match, the model decides.
PROPOSALS = {
    "email": [rf"{_AT}[\w-]+(?:{_DOT}[\w-]+)+"],
    "phone": [r"(?<![\w/.,+-])(?<!\d\s)(?:\(\+?\d{1,3}\)|\+\d{1,3}|00\d{2}(?=[ .-])|1(?=[ .-]\d{3}[ .-]))?[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,12}(?:(?:[ .-]|\s?/\s?)\d{2,9}){0,5}(?![\w/]|[.,-]\d)"],
    "ident": [
        r"(?<![\w/.-])\d{2}[. ]?\d{3}[. ]?\d{3}[ .-]?[A-Za-z](?!\w)", r"(?<![\w/.-])[XYZxyz][ .-]?(?:\d{7}|\d\.\d{3}\.\d{3}|\d \d{3} \d{3})[ .-]?[A-Za-z](?!\w)", r"(?<![\w/.-])[A-Z]{3} ?\d{6}[A-Z]?(?!\w)", r"(?<![\w/.-])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z0-9]*\d){3})[A-Z0-9]{9,11}(?!\w)", r"(?<![\w/.-])\d{2}[/ ]\d{7,8}[/ ]\d{2}(?![\w/])", r"(?<![\w/.-])\d{2}-\d{8}-\d{2}(?!\w)",
        r"(?<![\w/.-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", r"(?<![\w/.-])\d{3}-\d{2}-\d{4}(?![\w-])", r"(?<![\w/.-])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\w)", r"(?<![\w/.-])\d{12}(?!\w)",
        r"(?<![\w/.-])\d{9}(?!\w)", r"(?<![\w/.-])(?<!\d )\d{3} \d{3} \d{3}(?! ?\d|\w)", r"(?<![\w/.-])\d{2} \d{3} \d{3} \d{3}(?!\w)", r"(?<![\w/.-])\d{8}-?[A-Z](?!\w)", r"(?<![\w/.-])\d{8} \d [A-Z]{2}\d(?!\w)", r"(?<![\w/.-])[A-Z]{4}\d{6}[A-Z]{6}[A-Z0-9]\d(?!\w)", r"(?<![\w/.-])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?!\w)",
    ],
    "address": [
        rf"(?<![\w.]){_ROAD_BEFORE}\s*{_NAMEWORDS}{_NUM}{_FLOOR}",
        rf"(?<![\w.])(?:(?:Flat|Apt\.?|Unit|Suite|FLAT)\s\d+[A-Za-z]?,?\s)?\d{{1,4}}[A-Z]?,?\s(?:{_U}[\w'’]*\s){{1,3}}{_ROAD_AFTER}(?!\w)",
        rf"(?<![\w.]){_U}\w*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|STRASSE|WEG|GASSE|STRAßE)\s\d{{1,4}}(?:\s?[a-z]\b)?",
        rf"(?<![\w.])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|av\.|boulevard|bd|allée|impasse|quai|chemin|place|cours|route|passage)\s(?:(?:de la|de l['’]|du|des|de|d['’])\s?)?(?:{_U}[\w'’-]*\s?)+",
    ],
}
_EMAIL = regex.compile(PROPOSALS["email"][0])
_NUMBERS = [(kind, regex.compile(p)) for kind in ("phone", "ident") for p in PROPOSALS[kind]]
_ADDRESSES = [regex.compile(p) for p in PROPOSALS["address"]]
_FLATS = re.compile(r"(?<![\w.])(?:Flat|Apt|Unit|Suite|FLAT)")
_GERMAN_ROADS = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|STRASSE|WEG|GASSE|STRAßE)\s\d")
_ROADS = re.compile(r"(?<![\w.])(?:c(?:alle(?:jón)?|/|amino|no\.|arretera|tra\.?)|a(?:venida|vda\.?|v\.|lameda)|p(?:aseo|\.º|º|laza|za\.?|l\.|asaje|raça)|r(?:onda|ua|\.)|t(?:ravesía|rav\.|ravessa|v\.)|glorieta|largo|urbanización|carrer|avinguda|plaça|passeig)", re.I)
#: Digits, how far from one a number's characters and what stands before it may lie, and how few no number has.
_DIGITS, _MARGIN, LEAST_DIGITS = re.compile(r"\d+"), 24, 3
_TOKEN = regex.compile(rf"(?P<initial>{_U}\.(?:-{_U}\.)?)|(?P<word>{_W})(?![\p{{L}}])")
_SMALL_WORDS = r"\s(?:de la|de los|de las|del|de|da|do|dos|das|van der|van|von|y|e|du)\s"
_PARTICLE = regex.compile(_SMALL_WORDS)
#: Two and more words that may be a name, as they stand together.
_ONE = rf"(?:{_U}\.(?:-{_U}\.)?|{_W}(?![\p{{L}}]))"
_LOW_WORD = regex.compile(r"(?<![\w@.+-])\p{Ll}[\p{Ll}\p{M}'’-]+(?![\w@])")
_LOW_RUN = regex.compile(r"(?<![\w@.+-])\p{Ll}[\p{Ll}\p{M}'’-]+(?:,? \p{Ll}[\p{Ll}\p{M}'’-]+)+(?![\w@])")
_RUN = regex.compile(rf"{_ONE}(?:(?: |, |{_SMALL_WORDS}){_ONE})+")
_MARKS = regex.compile(r"\p{M}+")
_LETTERS = regex.compile(r"\p{L}+")
_GOOD, _SEPARATORS, _AMERICAN = re.compile(r"[gI]{1,2}s{1,2}|s{1,2},[gI]{1,2}|sg"), re.compile(r"(?<=\d)[ .-](?=\d)"), re.compile(r"(?:\+1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
#: The end of a sentence, not of an abbreviation.
_FULL_STOP = re.compile(r"\w{3}[.!?]\s")
#: Titles and other words that stand before a name or look like part of one.
TITLES = set("mr mrs ms miss dr dra sr sra srta d dña dna don doña dona prof herr frau madame monsieur mme m senhor senhora mister sir lady mlle".split())
NOT_NAMES = TITLES | set("estudio grupo contact contacto contacta ansprechperson segun según firmado saludos saludo regards un el la los las the si no te para room sala premio le les das der die el os as signed telefon telephone teléfono seleccion selección jobs rrhh de von steuernummer mi my".split())
#: Words before or after a candidate that make it a company, a room, a prize.
BODIES = set("premio premios sala room estudio grupo casa fundacion fundación beca aula edificio torre prize award ltd gmbh sl sa slu inc llc fundação prix preis saal salle prémio colegio escuela school hotel bar colección auditorio foundation building hall studio fondation stiftung cátedra consulting partners talento".split())
_CUE = {
    "phone": set("llámame llamame teléfono telefono móvil movil tel tlf número numero mobile phone call ring reach dudas questions ruf handy téléphone appelez telemóvel ligue".split()),
    "ident": set("identificación identificacion documento dni nie nif national number holds social sociale sécurité seguridad file tratamiento pasaporte identidad passport ausweis".split()),
    "no": set("tique ticket versión version oferta posting lote batch factura invoice presupuesto muestra sample coordenadas salarial salary band referencia ref pedido order no n.º euros respuestas answers publicada live".split()),
    "closing": set("firmado signed contacto contact ansprechperson saludo saludos regards grüße grüßen cumprimentos cordialement atentamente sincerely atenciosamente".split()),
    "name": set("con with avec mit com por for avisar candidata candidate según to pregunta hablé spoke parlé gesprochen falei referencias".split()),
}
_NEAR = regex.compile(r"[\p{L}\p{N}.º&]+")


@lru_cache(1 << 17)
def fold(word: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", word)).lower()


class Segment:
    __slots__ = ("start", "end", "kind", "features")

    def __init__(self, start: int, end: int, kind: str, features: list[str]):
        self.start, self.end, self.kind, self.features = start, end, kind, features


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    left = [fold(w) for w in _NEAR.findall(text[max(0, start - 40) : start])][-4:]
    right = [fold(w) for w in _NEAR.findall(text[end : end + 30])][:3]
    return left, right


def _shape(s: str) -> str:
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: str(len(m[0])), s))


def _windows(numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of a text around its digits, wide enough for everything written with some; only those with LEAST_DIGITS."""
    start = end = digits = 0
    for a, b in [*numbers, (1 << 62, 1 << 62)]:
        if a - _MARGIN > end:
            if digits >= LEAST_DIGITS:
                yield start, end
            start, digits = max(0, a - _MARGIN), 0
        end = b + _MARGIN
        digits += b - a


def _proposed(text: str) -> Iterator[tuple[int, int, str]]:
    """Candidate spans of all kinds but names."""
    if _ATSIGN.search(text):
        for m in _EMAIL.finditer(text):
            s = m.start()
            while s and (text[s - 1].isalnum() or text[s - 1] in "_.+%-"):
                s -= 1
            if s < m.start() and not (s and text[s - 1] == "@"):
                yield s, m.end(), "email"
    numbers = [m.span() for m in _DIGITS.finditer(text)]
    if not numbers:
        return
    for a, b in _windows(numbers):
        for kind, p in _NUMBERS:
            for m in p.finditer(text, a, b):
                yield *m.span(), kind
    before, english, german, french = _ADDRESSES
    starts = [(before, m.start()) for m in _ROADS.finditer(text)] + [(english, m.start()) for m in _FLATS.finditer(text)]
    starts += [(p, a) for a, b in numbers if b - a <= 4 for p in (english, french)]
    for p, at in starts:
        if (found := p.match(text, at)) is not None:
            yield *found.span(), "address"
    if _GERMAN_ROADS.search(text):
        for m in german.finditer(text, overlapped=True):
            yield *m.span(), "address"


class Model:
    """Weights, name lexicon, and the dynamic programme."""

    def __init__(self, names: dict[str, str], weights: dict[str, float] | None = None):
        """``names``: folded word to roles, "g" given name, "s" surname, "gs" both."""
        self.names, self.weights = names, weights or {}
        self._folded = frozenset(w.encode() for w in names)

    def role(self, word: str) -> str:
        known = {self.names.get(fold(p), "") for p in word.split("-")}
        joined = "".join(sorted({c for k in known for c in k}))
        return joined if "" not in known else "?"

    def segments(self, text: str, lang: str | None = None) -> list[Segment]:
        out: dict[tuple, Segment] = {}
        for s, e, kind in _proposed(text):
            while s < e and text[s] in " .-":
                s += 1
            while e > s and text[e - 1] in " ,\n":
                e -= 1
            if (s, e, kind) not in out and (kind != "phone" or 8 <= sum(c.isdigit() for c in text[s:e]) <= 15):
                out[s, e, kind] = Segment(s, e, kind, self._features(text, s, e, kind))
        out |= self._names(text, lang)
        return list(out.values())

    def _features(self, text: str, s: int, e: int, kind: str) -> list[str]:
        span = text[s:e]
        left, right = _around(text, s, e)
        f = [kind]
        if kind in ("phone", "ident"):
            digits = "".join(c for c in span if c.isdigit())
            f += [f"{kind} cue"] if _CUE_FOLDED[kind] & set(left) else []
            f += [f"{kind} not"] if _CUE_FOLDED["no"] & {*left[-2:], *right[:1]} else []
            if kind == "phone":
                seps = set(_SEPARATORS.findall(span))
                national = digits[2:] if digits.startswith("34") and ("+" in span) else digits[4:] if digits.startswith("0034") else digits
                f.append("phone plus" if span[0] in "+(" and "+" in span[:3] else "phone 00" if digits.startswith("00") else f"phone bare {len(digits)} {digits[0]}")
                f.append(f"phone seps {len(seps)}")
                f.append("phone spain" if len(national) == 9 and national[0] in "6789" else "phone us" if _AMERICAN.fullmatch(span) else "phone uk" if digits.lstrip("0").startswith(("44", "20", "1")) and 10 <= len(digits) <= 13 and digits[0] in "04" else "phone other")
                f.append(f"phone bracket {span.startswith('(')}")
            else:
                f.append("ident " + _shape(span))
                f.append("ident letter" if span[-1].isalpha() else "ident digits")
        elif kind == "email":
            f.append("email plain" if regex.fullmatch(r"\S+@\S+", span) else "email spaced" if "@" in span else "email words")
            f.append("email known end" if regex.search(r"(?:test|example|com|org|net|es|de|fr|pt|uk|eu|io)$", span.lower()) else "email other end")
        elif kind == "address":
            f.append("address floor" if regex.search(r"[ºª]|bajo|r/c|Flat|bis", span) else "address short")
            f.append(f"address words {min(4, len(span.split()))}")
            f.append("address lower" if span[0].islower() else "address upper")
            f.append("address longer" if len(span) > 22 else "address long")
            f += ["address line"] if "\n" in span else []
            f += ["address flat before"] if regex.search(r"(?:Flat|Apt\.?|FLAT)\s\d+[A-Za-z]?,?\s$", text[max(0, s - 12) : s]) else []
        return f

    def _names(self, text: str, lang: str | None) -> dict[tuple, Segment]:
        out: dict[tuple, Segment] = {}
        for whole in _RUN.finditer(text):
            run, last = [], whole.start()
            for m in _TOKEN.finditer(text, *whole.span()):
                run.append((m.start(), m.end(), "I" if m.lastgroup == "initial" else self.role(m[0]), text[last : m.start()]))
                last = m.end()
            out |= self._spans(text, run, lang)
        if len(self._folded.intersection(S.words(text))) > 1 and sum(w.islower() and fold(w.strip(",.;:")) in self.names for w in text.split()) > 1:
            for whole in _LOW_RUN.finditer(text):
                run, last = [], whole.start()
                for m in _LOW_WORD.finditer(text, *whole.span()):
                    # written small, only known words are candidates
                    if (role := self.role(m[0])) == "?":
                        out |= self._spans(text, run, lang)
                        run, last = [], m.end()
                        continue
                    run.append((m.start(), m.end(), role, text[last : m.start()]))
                    last = m.end()
                out |= self._spans(text, run, lang)
        return out

    def _spans(self, text: str, run: list[tuple[int, int, str, str]], lang: str | None) -> dict[tuple, Segment]:
        """Candidates of two and more neighbouring words."""
        out: dict[tuple, Segment] = {}
        if run:
            for i in range(len(run)):
                for j in range(i + 1, min(len(run), i + MOST_WORDS)):
                    inner = [run[k][3] for k in range(i + 1, j + 1)]
                    commas = sum(g == ", " for g in inner)
                    if commas > 1:
                        break
                    s, e = run[i][0], run[j][1]
                    out[s, e, "name"] = Segment(s, e, "name", self._name_features(text, run, i, j, [r for _, _, r, _ in run[i : j + 1]], inner, commas, lang))
        return out

    def _name_features(self, text, run, i, j, roles, inner, commas, lang) -> list[str]:
        s, e = run[i][0], run[j][1]
        left, right = _around(text, s, e)
        at = inner.index(", ") + 1 if commas else 0
        order = [r if r in ("I", "?") else "g" if "g" in r and (r == "g" or (k >= at if commas else k == 0)) else "s" if "s" in r else "g" for k, r in enumerate(roles)]
        pattern = "".join(c + ("," if commas and k == at - 1 else "") for k, c in enumerate(order))
        good = _GOOD.fullmatch(pattern) is not None
        f = ["name", "name good" if good else "name odd", "name initial" if "I" in order else "name full", f"name words {len(roles)}"]
        f += ["name in small letters"] if text[s].islower() else []
        f += ["name particle"] if any(_PARTICLE.fullmatch(g) for g in inner) else []
        f += ["name comma"] if commas else []
        cues = {fold(w) for w in _NEAR.findall(_FULL_STOP.split(text[max(0, s - 40) : s])[-1])[-2:]}
        beside = "title" if left and left[-1].rstrip(".") in TITLES_FOLDED and "\n" not in text[max(0, s - 3) : s] else "closing" if cues & _CUE_FOLDED["closing"] else "cue" if cues & _CUE_FOLDED["name"] else "line" if text[s - 1 : s] in ("", "\n") and text[e : e + 1] in ("", "\n") else "nothing"
        f.append(f"name beside {beside}")
        if "?" in roles:
            known = set("".join(roles)) & set("gs")
            f += [f"name unknown {'all' if not known else 'with ' + ''.join(sorted(known)) + (' first' if roles[0] != '?' else ' later')} beside {beside}", "name unknown"]
            f += ["name of small words"] if any(r == "?" and _SMALL.fullmatch(text[a:z]) for a, z, r, _ in run[i : j + 1]) else []
            f += ["name of title words"] if any(fold(text[a:z]).rstrip(".") in TITLES_FOLDED for a, z, _, _ in run[i : j + 1]) else []
            f += ["name of usual words"] if any(r == "?" and fold(text[a:z]) in _NOT_FOLDED for a, z, r, _ in run[i : j + 1]) else []
            f += ["name in capitals"] if all(text[a:z].isupper() for a, z, r, _ in run[i : j + 1]) else []
        elif not any("s" in r for r in roles) or not any("g" in r or r == "I" for r in roles):
            f.append("name one part only")
        body = (left and left[-1].rstrip(".") in BODIES_FOLDED) or (right and right[0].rstrip(".") in BODIES_FOLDED)
        f += ["name of a body"] if body else []
        f += ["name amp"] if (left and left[-1] == "&") or (right and right[0] == "&") else []
        # words of names left outside
        before, after = run[i - 1] if i else None, run[j + 1] if j + 1 < len(run) else None
        f += ["name cut left"] if before and run[i][3] == " " and before[2] in ("g", "s", "gs") else []
        f += ["name cut left comma"] if before and run[i][3] == ", " and before[2] in ("s", "gs") and not commas else []
        f += ["name cut left unknown"] if before and run[i][3] == " " and before[2] == "?" and fold(text[before[0] : before[1]]) not in _NOT_FOLDED else []
        f += ["name cut right unknown"] if after and after[3] == " " and after[2] == "?" else []
        f += ["name initial left"] if before and run[i][3] == " " and before[2] == "I" and fold(text[before[0] : before[1]]).rstrip(".") not in TITLES_FOLDED else []
        f += ["name cut right"] if after and after[3] != ", " and ("s" in after[2] or "g" in after[2]) else []
        f += ["name cut right comma"] if after and after[3] == ", " and ("g" in after[2] or after[2] == "I") and not commas and "g" not in "".join(order) else []
        if order[0] == "I" and len(order) > 1:
            initial = text[run[i][0]].lower()
            if (initial, (lang or "")[:2]) in (("d", "es"), ("m", "fr")) and (order[1] in "gI" or commas):
                f.append("name title inside")
            elif order[1] == "g":
                f.append("name initial given")
        return f

    def score(self, segment: Segment) -> float:
        w = self.weights
        return sum(w.get(x, 0.0) for x in segment.features)

    def best(self, text: str, lang: str | None = None) -> list[Segment]:
        """The best set of segments that do not overlap, in order."""
        found = sorted(self.segments(text, lang), key=lambda x: x.end)
        if not found:
            return []
        ends, value, back = [0], [0.0], [None]
        for seg in found:
            lo, hi = 0, len(ends)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if ends[mid] <= seg.start else (lo, mid)
            total = value[lo - 1] + self.score(seg)
            if total > value[-1]:
                ends.append(seg.end)
                value.append(total)
                back.append((seg, lo - 1))
        out, at = [], len(ends) - 1
        while at and back[at]:
            out.append(back[at][0])
            at = back[at][1]
        return out[::-1]

    def train(self, rounds: int = 60, rate: float = 0.2, ridge: float = 0.01) -> Model:
        """Fit the weights to the marked sentences by the gradient of the conditional likelihood."""
        data = []
        for line in EXAMPLES.strip().split("\n"):
            text, gold = _unmark(line.replace("\\n", "\n"))
            segs = sorted(self.segments(text), key=lambda x: x.end)
            right = {min((x for x in segs if x.kind == k and x.start == s), key=lambda x: abs(x.end - e), default=None) for s, e, k in gold}
            data.append((segs, right - {None}, sorted({0, *(p for x in segs for p in (x.start, x.end))})))
        for n in range(rounds):
            step = rate / (1 + n / 20)
            for segs, right, points in data:
                place = {p: i for i, p in enumerate(points)}
                by_end: dict[int, list[Segment]] = {}
                by_start: dict[int, list[Segment]] = {}
                for x in segs:
                    by_end.setdefault(place[x.end], []).append(x)
                    by_start.setdefault(place[x.start], []).append(x)
                score = {x: self.score(x) for x in segs}
                ahead, behind = [0.0] * len(points), [0.0] * len(points)
                for i in range(1, len(points)):
                    ahead[i] = _log_sum([ahead[i - 1], *(ahead[place[x.start]] + score[x] for x in by_end.get(i, []))])
                for i in range(len(points) - 2, -1, -1):
                    behind[i] = _log_sum([behind[i + 1], *(behind[place[x.end]] + score[x] for x in by_start.get(i, []))])
                for x in segs:
                    gradient = (x in right) - math.exp(min(0.0, ahead[place[x.start]] + score[x] + behind[place[x.end]] - ahead[-1]))
                    if abs(gradient) > 1e-4:
                        for feature in x.features:
                            self.weights[feature] = self.weights.get(feature, 0.0) * (1 - step * ridge) + step * gradient
        return self


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def _unmark(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, gold, at = "", [], 0
    for m in regex.finditer(r"\{(\w+)\|([^}]*)\}", line):
        text += line[at : m.start()]
        gold.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], gold


#: Particles, also in capitals, which are no names.
_SMALL = regex.compile(r"(?i:d[aeo]s?|del|du|des|l[ao]s?|les?|el|von|van|der|den|y|e)")
_ATSIGN = re.compile(r"@|[\[({<]\s*(?:at|arroba|a)\s*[\])}>]|\s(?:arroba|at)\s", re.I)
_CUE_FOLDED = {k: {fold(w) for w in v} for k, v in _CUE.items()}
TITLES_FOLDED, BODIES_FOLDED, _NOT_FOLDED = {fold(w) for w in TITLES}, {fold(w) for w in BODIES}, {fold(w) for w in NOT_NAMES}
#: Names of the marked sentences, known to the model while it is trained.
EXAMPLE_NAMES = {"g": "ana luis emma harold birgit udo claire marc rita rui", "s": "robledo cantero mora whitlow penrose lindner dubreuil sequeira"}

_PAIR = regex.compile(rf"(?P<before>,\s)?\b(?P<a>{_W})(?P<gap>,? )(?P<b>{_W})(?P<after>,\s{_U})?(?![\p{{L}}])")
_WRITTEN = regex.compile(r"(?<![\w.@+-])[\p{L}\p{M}]{3,}(?![\w@+]|[.-]\w|\s*[\[({<@])")


def _listed(names: DataFrame) -> dict[str, str]:
    out: dict[str, str] = {}
    for r in bounded(names.select("name", "kind").where("name is not null and kind is not null"), MOST_LISTED, "person names"):
        role = "g" if r["kind"] == "given" else "s"
        out[fold(r["name"])] = "".join(sorted(set(out.get(fold(r["name"]), "") + role)))
    return out


def _pairs(text: str) -> Iterator[tuple[str, str, int]]:
    """Capitalised words that stand together, folded, and how: 1 for a comma between them, 2 for one before, 4 for one after."""
    for m in _PAIR.finditer(text, overlapped=True):
        yield fold(m["a"]), fold(m["b"]), (m["gap"] == ", ") | 2 * bool(m["before"]) | 4 * bool(m["after"])


def _partners(a: str, b: str, how: int, names: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(word, role, partner) for a capitalised word beside a known name."""
    comma, before, after = how & 1, how & 2, how & 4
    ka, kb = (names.get(x) or (names.get(x.split("-")[0], "") if "-" in x else "") for x in (a, b))
    for w, other, partner, role in ((b, a, ka, "g" if comma else "s"), (a, b, kb, "s" if comma else "g")):
        if not partner or w in names or w in _NOT_FOLDED or len(w) < 3:
            continue
        # given then surname; surname, given
        fits = "g" in partner if role == "s" else "s" in partner
        if fits and not (role == "s" and not comma and before) and not (role == "g" and not comma and after):
            for part in w.split("-") if role == "s" else [w]:
                yield part, role, other


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with how often they are written in capitals and in small letters (how = -1), and pairs of words."""
    for b in batches:
        words: dict[str, list[int]] = {}
        pairs: Counter[tuple[str, str, int]] = Counter()
        for t in b.column(0).to_pylist():
            for w in _WRITTEN.findall(t):
                words.setdefault(w, [0])[0] += 1
            pairs.update(_pairs(t))
        folded: dict[str, list[int]] = {}
        for w, (n,) in words.items():
            folded.setdefault(fold(w), [0, 0])[w[0].islower()] += n
        rows = [(w, "", -1, c, l) for w, (c, l) in folded.items()] + [(*p, n, 0) for p, n in pairs.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "how", "capital", "lower"])


def lexicon(df: DataFrame, text: str, names: DataFrame) -> dict[str, str]:
    """Folded words of person names with their roles: the list, grown from all texts of ``df`` until nothing is added.

    The texts are read once, for the pairs of capitalised words in them; the rounds go over the distinct pairs.
    """
    known = _listed(names)
    source = spread(df.select(F.col(text)).where(F.col(text).isNotNull()))
    counted = source.mapInArrow(_counted, "a string, b string, how int, capital bigint, lower bigint").groupBy("a", "b", "how").agg(F.sum("capital").alias("c"), F.sum("lower").alias("l"))
    counted = durable(counted.where((F.col("how") >= 0) | (F.col("c") >= LEAST_CAPITAL * (F.col("c") + F.col("l")))))
    pairs, capital = counted.where("how >= 0").select("a", "b", "how", "c"), counted.where("how < 0").select(F.col("a").alias("word"), F.col("c").alias("places"))
    while True:
        shared = df.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            have = shared.value
            for b in batches:
                rows = [(*x, n) for a, z, how, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in set(_partners(a, z, how, have))]
                columns = [pa.array([r[k] for r in rows], pa.string() if k < 3 else pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "role", "partner", "places"])

        met = pairs.mapInArrow(run, "word string, role string, partner string, places bigint").groupBy("word", "role").agg(F.count_distinct("partner").alias("n"), F.sum("places").alias("beside"))
        met = met.join(capital, "word").where((F.col("n") >= LEAST_PARTNERS) & (F.col("beside") >= LEAST_BESIDE * F.col("places")))
        # a word of two roles has the one with more partners
        new = {}
        for r in sorted(bounded(met.select("word", "role", "n"), MOST_NAMES, "names in texts"), key=lambda r: (-r["n"], r["word"], r["role"])):
            if r["word"] not in known:  # part of a double name
                new.setdefault(r["word"], r["role"])
        if not new:
            return known
        known = known | new


def trained(names: dict[str, str]) -> dict[str, float]:
    """Weights of the model: fitted with the listed names and those of the marked sentences."""
    return Model({w: r for r, ws in EXAMPLE_NAMES.items() for w in ws.split()} | names).train().weights


def items(df: DataFrame, key: str, text: str, lang: str, names: DataFrame) -> DataFrame:
    """(key, kind, start_at, end_at, item): one row for every item; ``start_at`` counts code points from 0."""
    known = lexicon(df, text, names)
    shared = df.sparkSession.sparkContext.broadcast((known, trained(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            rows = [(i, x.kind, x.start, x.end, t[x.start : x.end]) for i, (t, g) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if t for x in model.best(t, g)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], ["key", "kind", "start_at", "end_at", "item"]
            )

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text), F.col(lang))).mapInArrow(run, f"key {kind}, kind string, start_at int, end_at int, item string").withColumnRenamed("key", key)


def redact(text: str, found: list[Segment]) -> str:
    """The text with every item replaced by a placeholder of its kind."""
    out, at = [], 0
    for x in found:
        out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = x.end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, key: str, text: str, lang: str, names: DataFrame) -> DataFrame:
    """(key, redacted): every text with typed placeholders; null and empty texts stay as they are."""
    known = lexicon(df, text, names)
    shared = df.sparkSession.sparkContext.broadcast((known, trained(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            out = [redact(t, model.best(t, g)) if t else t for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "redacted"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text), F.col(lang))).mapInArrow(run, f"key {kind}, redacted string").withColumnRenamed("key", key)
