"""Template residue, filler, error pages and script notices among descriptions (exemplar retrieval, TF-IDF containment).

Labelled exemplars of residue are held in an inverted index from term to exemplar.  A text is read in overlapping passage windows; the terms of a window
retrieve exemplars, rarest term first, and each retrieved exemplar is scored by containment: the TF-IDF mass of the exemplar that the window holds.
Weights come from the document frequencies of the exemplars' terms over all texts.  Syntax of templates ({{x}}, %x%, [[x]], runs of underscores) is one
term each, so a placeholder is an exemplar of one term.

A text is residue if a placeholder is contained in some window, if a dummy phrase is a line or sentence of its own, if a few words in a row, wherever they begin, are mostly filler vocabulary (that of the classical
passage, and the words that the corpus uses beside it and hardly elsewhere), or if windows that contain enough of a message (an error, a notice) cover most of its weight; a description that merely speaks of such things has other words around them.  Null, empty and
blank texts are not residue; texts of any length are read whole, window by window.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazario.common import bounded, spread
from plazario.llm import shingles as S

#: Names of the usual HTTP states, which follow a number or stand alone.
STATES = [
    "bad request", "unauthorized", "forbidden", "not found", "method not allowed", "request timeout", "gone", "too many requests", "internal server error", "bad gateway", "service unavailable", "gateway timeout",
    "solicitud incorrecta", "no autorizado", "prohibido", "no encontrado", "recurso no encontrado", "recurso eliminado", "tiempo de espera agotado", "demasiadas solicitudes", "demasiadas peticiones", "error interno del servidor", "puerta de enlace incorrecta", "servicio no disponible",
    "nicht gefunden", "zugriff verboten", "interner serverfehler", "dienst nicht verfügbar", "introuvable", "accès interdit", "erreur interne du serveur", "service indisponible", "não encontrado", "acesso proibido", "erro interno do servidor", "serviço indisponível",
]
#: Forms in which a state is reported; 1 stands for any number.
STATE_FORMS = ["{}", "1 {}", "error 1 {}", "http 1 {}", "nginx 1 {}", "apache server 1 {}"]
#: Further exemplars by label.
EXEMPLARS = {
    "placeholder": [
        "[insertar", "[insert", "[añadir", "[add", "[completar", "[complete", "[rellenar", "[escribir", "[nombre de", "[nombre del", "[your", "[company name", "[job title", "[tu empresa", "[su empresa", "[ihr name", "[votre", "<insertar", "<insert", "<añadir", "<add", "<completar", "<nombre de", "<company name", "<your", "<tu empresa",
        "(completar", "(rellenar antes", "(por completar", "(escriba aquí", "(escribir aquí", "(write here", "(complete before", "(fill in", "(a completar", "(bitte ausfüllen", "(à compléter", "(a preencher",
    ],
    "dummy": [
        "aquí irá la descripción", "aquí va el texto", "descripción del puesto aquí", "descripción por redactar", "texto pendiente de redactar", "texto pendiente", "pendiente de completar", "la descripción está pendiente", "por completar por rrhh", "pegar aquí el texto definitivo", "TODO: pegar texto", "TODO: escribir descripción",
        "texto provisional", "texto de relleno", "texto de ejemplo", "texto de prueba", "no publicar es prueba", "oferta de prueba", "prueba prueba", "description to follow", "the description goes here", "job description here", "your text here", "text to be written", "to be completed by hr", "to be confirmed by hr", "TODO: add description",
        "placeholder text", "sample text", "dummy text", "this is a test do not publish", "test posting please ignore", "test test", "testing 1", "hier steht die beschreibung", "beschreibung folgt", "texte à venir", "description à compléter", "texto a definir", "descrição por escrever",
        "asdf", "asdf asdf", "qwerty", "qwerty qwerty", "zxcv", "xxx", "xxx xxx", "aaaaa", "bbbbb", "blablabla", "bla bla", "tbd", "n/a", "por definir",
    ],
    "message": [
        "página no encontrada", "no se ha encontrado la página", "la página solicitada no existe", "no existe la página que has solicitado", "la página que buscas no está disponible", "esta página ya no está disponible", "page not found", "the page was not found", "the requested page does not exist", "the page you requested does not exist",
        "acceso denegado", "se ha denegado el acceso a esta página", "no tienes permiso para acceder a este recurso", "se necesita permiso para ver este recurso", "access denied", "access to this page has been denied", "you do not have permission to access this resource", "permission is required to view this resource",
        "la oferta ya no está disponible", "esta oferta ya no existe en el portal", "la oferta ha caducado y ha sido retirada", "oferta retirada o caducada", "this job is no longer available", "the job you requested is no longer available", "this listing has expired and was removed", "the listing was removed or has expired",
        "estamos en mantenimiento, vuelve más tarde", "sitio en mantenimiento, vuelve en 1 minutos", "the site is down for maintenance, come back later", "we are down for maintenance, please come back in 1 minutes", "algo ha ido mal, vuelve a intentarlo más tarde", "lo sentimos, algo ha ido mal",
        "se ha producido un error, inténtalo de nuevo más tarde", "lo sentimos, se ha producido un error", "something went wrong, please try again", "sorry, something went wrong", "an unexpected error has occurred", "sorry, an unexpected error occurred, try again later",
        "el servicio no está disponible temporalmente", "servicio temporalmente no disponible", "service temporarily unavailable", "the service is temporarily unavailable", "the server took too long to respond", "the upstream server took too long and did not respond", "el servidor ha tardado demasiado en responder", "el servidor tardó demasiado",
        "connection timed out", "the connection to the server timed out", "too many requests, slow down and retry later", "you have sent too many requests, slow down", "has hecho demasiadas peticiones, espera unos minutos", "demasiadas peticiones, espera", "tu sesión ha caducado, inicia sesión de nuevo", "la sesión ha caducado, vuelve a iniciar sesión para continuar",
        "your session has expired, sign in again", "the session expired, please sign in again to continue", "inicia sesión para ver la oferta completa", "para ver la descripción completa inicia sesión", "sign in to see the full description", "please sign in to view the full job description",
        "verifica que eres humano para continuar", "verifica que eres una persona y no un robot", "verify that you are human", "verify you are human to continue", "checking your browser, please wait", "please wait while your browser is checked", "traceback (most recent call last)", "traceback most recent call render() got none",
        "seite nicht gefunden", "die seite wurde nicht gefunden", "zugriff verweigert", "der zugriff auf diese seite wurde verweigert", "ein fehler ist aufgetreten, bitte versuchen sie es später", "es ist ein fehler aufgetreten", "page introuvable", "la page demandée est introuvable", "accès refusé", "accès refusé à cette page",
        "une erreur est survenue, veuillez réessayer", "une erreur est survenue", "página não encontrada", "a página não foi encontrada", "acesso negado", "acesso negado a esta página", "ocorreu um erro, tente novamente mais tarde", "ocorreu um erro",
    ],
    "scripts": [
        "activa javascript para ver esta página", "debes activar javascript para ver la página", "habilita javascript para continuar", "es necesario que habilites javascript", "contenido dinámico no disponible, habilita js", "habilita js para ver el contenido dinámico", "esta web necesita javascript", "esta página necesita javascript",
        "los scripts del navegador deben estar habilitados", "este sitio requiere scripts habilitados en el navegador", "tu navegador no admite scripts", "tu navegador tiene los scripts bloqueados o no los admite", "permite la ejecución de scripts para cargar la oferta", "cargando, si no ves la oferta permite los scripts",
        "please enable javascript", "enable javascript and reload the page", "you need to enable javascript to continue", "to continue you need javascript", "this site requires javascript", "javascript is required by this site", "javascript is disabled in your browser", "your browser has javascript disabled",
        "your browser does not support javascript", "javascript is not supported by your browser", "some features will not work without javascript", "without javascript some features do not work", "bitte aktivieren sie javascript", "javascript ist deaktiviert, bitte aktivieren", "veuillez activer javascript pour afficher la page", "veuillez activer les scripts pour afficher la page",
        "ative o javascript", "ative o javascript para ver a página", "abilita javascript per vedere la pagina", "abilita javascript",
    ],
    "furniture": [
        "inicio ofertas contacto", "inicio | empleo | contacto", "menú buscar entrar", "menú | buscar | acceder", "portal de empleo", "bolsa de empleo", "todos los derechos reservados", "all rights reserved", "skip to content", "ir al contenido", "aceptar cookies", "accept cookies", "política de privacidad", "privacy policy", "aviso legal",
        "volver", "volver al inicio", "recargar la página", "reload the page", "home jobs contact", "reference", "código 1", "ref id", "id 1",
    ],
}
#: The classical dummy passage; the words that a corpus mixes with its words are learnt from the corpus.
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum pellentesque vestibulum curabitur maecenas vivamus fusce mauris".split()
)
#: Words that are dummy Latin by themselves: others of the passage are words of living languages too.
TELLING_FILLER = FILLER - set("dolor sit sed magna labore culpa officia velit tempor commodo elit nulla esse anim quis enim nisi".split())
#: A word belongs to the filler of a corpus if so many texts have it within NEAR_FILLER words of two of the passage, and these are such a part of the texts that have it.
LEAST_TEXTS, LEAST_PART, NEAR_FILLER = 3, 0.6, 8
#: Words that a corpus may add (more are refused, none is left out).
MOST_LEARNT = 100_000
WINDOW, STEP = 24, 8
#: Dummy phrases that also leave a single field open; alone on a line of a description they say nothing of the description.
FIELD_VALUES = {"tbd", "n/a", "por definir"}
#: Containment at which an exemplar counts, by label; and the part of a text's weight that the words of exemplars must cover where one counts.
CONTAINED = {"placeholder": 0.99, "dummy": 0.6, "message": 0.4, "scripts": 0.4, "furniture": 0.6}
COVERED = 0.7
#: Of so many words in a row, at any place, how many of filler vocabulary are filler; and the part in texts of fewer words.
FILLER_WORDS, LEAST_FILLER, FILLER_PART = 6, 4, 0.75

_NAME = r"[A-Za-z_][\w.]*"
#: Template syntax, longest forms first; each is one term.
_SYNTAX = [
    ("syntax curly", rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{\s*{_NAME}\s*\}}"),
    ("syntax percent", rf"<%=?\s*{_NAME}\s*%>|%{_NAME}%"),
    ("syntax double", rf"\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|@@{_NAME}@@|\#{_NAME}\#|__{_NAME}?__"),
    ("syntax name", r"\[(?:[a-z]+[_.][\w.]+|[a-z]+[A-Z]\w*|[A-Z]{2,}(?:_[A-Z0-9]+)*|(?:puesto|ciudad|empresa|nombre|sector|salario|fecha|beneficios?|requisitos|contacto|company|name|title|location|city|salary|date))\]"),
    ("syntax blank", r"_{5,}|(?<!\w)X{4,}(?!\w)"),
]
_TERM = regex.compile("|".join([*(f"(?P<s{i}>{p})" for i, (_, p) in enumerate(_SYNTAX)), r"(?P<word>\p{N}+|[\p{L}\p{M}]+)", r"(?P<mark>[\[<(](?=\p{L}))", r"(?P<colon>(?<=TODO):)"]))
_ANY_SYNTAX = regex.compile("|".join(p for _, p in _SYNTAX))
#: One of these is in every piece of template syntax.
_SYNTAX_SIGNS = ("{", "%", "[[", "[", "<", "@@", "#", "__", "XXXX")
#: Ends of lines and sentences.
_PIECES = re.compile(r"[\r\n]+|(?<=[.!?;…])\s+|\s[–—•·|-]\s")
_MARKS = regex.compile(r"\p{M}+")


def terms(text: str) -> list[str]:
    """Terms in order: template syntax, folded words, "1" for a number, an opening bracket before a word."""
    out = []
    for m in _TERM.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            w = m[0]
            out.append("1" if w[0].isnumeric() else w.lower() if w.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", w)).lower())
        elif kind == "mark" or kind == "colon":
            out.append(m[0])
        else:
            out.append(_SYNTAX[int(kind[1:])][0])
    return out


def exemplar_terms(exemplars: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(label, terms) of every exemplar; template syntax is one placeholder each."""
    own = [("placeholder", [name]) for name, _ in _SYNTAX] + [("message", terms(form.format(x))) for x in STATES for form in STATE_FORMS]
    return own + [(label, terms(x)) for label, xs in (exemplars or EXEMPLARS).items() for x in xs]


def has_filler(words: list[str], filler: frozenset[str] | set[str] = FILLER) -> bool:
    """Whether some FILLER_WORDS words in a row, wherever they begin, hold LEAST_FILLER of filler vocabulary, one of them telling by itself."""
    telling = filler - FILLER | TELLING_FILLER
    if len(words) < FILLER_WORDS:
        n = sum(w in filler for w in words)
        return n > 2 and n >= FILLER_PART * len(words) and not telling.isdisjoint(words)
    at = [i for i, w in enumerate(words) if w in filler]
    return any(b - a < FILLER_WORDS and not telling.isdisjoint(words[a : b + 1]) for a, b in zip(at, at[LEAST_FILLER - 1 :], strict=False))


def beside_filler(words: list[str]) -> set[str]:
    """The words of a text within NEAR_FILLER words of two different ones of the passage that are not just its name, lorem ipsum."""
    at = [i for i, w in enumerate(words) if w in TELLING_FILLER]
    out: set[str] = set()
    for a, b in pairwise(at):
        if b - a <= NEAR_FILLER and words[a] != words[b] and words[a : b + 1] != ["lorem", "ipsum"]:
            out.update(words[max(0, a - NEAR_FILLER) : b + NEAR_FILLER + 1])
    return out


_MARKS_BEFORE = frozenset("[<(")
_FIELD_TERMS = [terms(x) for x in sorted(FIELD_VALUES)]


class Index:
    """Inverted index of the exemplars, with the weight of every term."""

    def __init__(self, frequency: dict[str, int], texts: int, learnt: Iterable[str] = (), exemplars: dict[str, list[str]] | None = None):
        self.exemplars = exemplar_terms(exemplars)
        self.frequency, self.filler = frequency, FILLER | set(learnt)
        self.usual = math.log(1 + (texts + 1) / (1 + texts / 50))
        self.counts = []
        for _, ts in self.exemplars:
            c: dict[str, int] = {}
            for t in ts:
                c[t] = c.get(t, 0) + 1
            self.counts.append(c)
        # numbers and brackets say little whatever their frequency
        self.weight = {t: math.log(1 + (texts + 1) / (1 + frequency.get(t, 0))) if t[0].isalpha() else 0.5 for c in self.counts for t in c}
        self.mass = [sum(self.weight[t] * n for t, n in c.items()) for c in self.counts]
        self.lists: dict[str, list[int]] = {}
        for i, c in enumerate(self.counts):
            # an exemplar is listed under its heaviest terms, so many that no window without any of them contains enough of it
            held = 0.0
            for t in sorted(c, key=lambda t: (-self.weight[t], t)):
                self.lists.setdefault(t, []).append(i)
                held += self.weight[t] * c[t]
                if held > (1 - CONTAINED[self.exemplars[i][0]]) * self.mass[i]:
                    break

        kinds = [label for label, _ in self.exemplars]
        self.vocabulary = {t for kind, c in zip(kinds, self.counts, strict=True) if kind != "placeholder" for t in c}
        self.dummies = {t for kind, c in zip(kinds, self.counts, strict=True) if kind == "dummy" for t in c}
        # for the first look at a text, folded to words in bytes
        listed = {kind: {t.encode() for t, es in self.lists.items() if t.isalpha() and any(kinds[e] == kind for e in es)} for kind in CONTAINED}
        self.told = {t.encode(): self.weight[t] for t in self.vocabulary if t.isalpha()}
        self.dummy_words, self.bracketed = listed["dummy"], listed["placeholder"]
        self.filler_words = {w.encode() for w in self.filler - FILLER | TELLING_FILLER}

    def contained(self, window: list[str]) -> list[int]:
        """Exemplars that the window contains."""
        have: dict[str, int] = {}
        for t in window:
            have[t] = have.get(t, 0) + 1
        out = []
        for i in {i for t in have if t in self.lists for i in self.lists[t]}:
            held = sum(self.weight[t] * min(n, have.get(t, 0)) for t, n in self.counts[i].items())
            if held >= CONTAINED[self.exemplars[i][0]] * self.mass[i]:
                out.append(i)
        return out

    def label(self, text: str | None) -> str | None:
        """Kind of residue of a text, null if it is a description (or nothing).

        The words alone tell of most texts that they are none: no template sign, no bracketed word, no filler, too little weight on the words of messages, no line of a dummy phrase's words.
        """
        if not text:
            return None
        words = S.words(text)
        have = set(words)
        if not have.isdisjoint(self.filler_words) and has_filler([w.decode() for w in words if w.isalpha()], self.filler):
            return "filler"
        signs = any(c in text for c in _SYNTAX_SIGNS) and _ANY_SYNTAX.search(text) is not None
        brackets = any(c in text for c in _MARKS_BEFORE) and not have.isdisjoint(self.bracketed)
        message = self._most(words) >= COVERED
        if (signs or brackets or message) and (found := self._windows(terms(text), message)):
            return found
        # a dummy phrase inside a description is one only if it stands apart
        return "message" if not have.isdisjoint(self.dummy_words) and any(self._dummy(p) for p in _PIECES.split(text) if len(p) <= 40 * WINDOW) else None

    def _most(self, words: list[bytes]) -> float:
        """The most that exemplars could cover of these words."""
        told = rest = 0.0
        for w in words:
            weight = self.told.get(w)
            if weight is not None:
                told += weight
            elif len(w) > 3 and w.isalpha():
                rest += self.usual
        return told / (told + rest) if told else 0.0

    def _windows(self, ts: list[str], message: bool) -> str | None:
        """What the windows of a text's terms contain: a placeholder, or enough of messages."""
        telling = [any(t in self.lists for t in ts[i : i + STEP]) for i in range(0, len(ts), STEP)]
        covered: set[int] = set()
        messages = False
        for n, i in enumerate(range(0, len(ts), STEP)):
            window = ts[i : i + WINDOW]
            if not any(telling[n : n + WINDOW // STEP]):
                continue
            for e in self.contained(window):
                label = self.exemplars[e][0]
                if label == "placeholder":
                    if self._adjacent(window, e):
                        return "placeholder"
                elif message:
                    messages = messages or label != "furniture"
                    covered |= {i + k for k, t in enumerate(window) if t in self.vocabulary}
        return "message" if messages and self._cover(ts, covered) >= COVERED else None

    def _cover(self, ts: list[str], covered: set[int]) -> float:
        """Part of the weight of a text's terms that lies on covered ones; references and numbers (ref. 3f2a91) belong to what they stand beside, as do short words of no exemplar."""
        told = sum(self.weight[ts[k]] for k in covered)
        rest = self.usual * sum(k not in covered and t != "1" and len(t) > 3 for k, t in enumerate(ts))
        return told / (told + rest) if told else 0.0

    def _dummy(self, piece: str) -> bool:
        """Whether a line or sentence is a dummy phrase and nothing else; the value of a field is none."""
        ts = [t for t in terms(piece) if t not in _MARKS_BEFORE]
        if not ts or len(ts) > WINDOW or ts in _FIELD_TERMS:
            return False
        inside = {k for k, t in enumerate(ts) if t in self.dummies}
        if len(inside) < min(3, len(ts)) or self._cover(ts, inside) < COVERED:
            return False
        return any(self.exemplars[e][0] == "dummy" and self.exemplars[e][1] not in _FIELD_TERMS for e in self.contained(ts))

    def _adjacent(self, window: list[str], e: int) -> bool:
        """Whether the exemplar's terms stand together and in order."""
        want = self.exemplars[e][1]
        n = len(want)
        return any(window[k : k + n] == want for k in range(len(window) - n + 1))


def frequencies(df: DataFrame, text: str) -> tuple[dict[str, int], int, list[str]]:
    """In how many texts each of the exemplars' words occurs, the number of texts, and the filler vocabulary of the corpus: counted over all rows.

    Words are counted in batches and added up by a shuffle; what reaches the driver is the exemplars' words and the filler, which is bounded.
    """
    own, telling = {t for _, ts in exemplar_terms() for t in ts if t.isalpha()}, {w.encode() for w in TELLING_FILLER}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, near, n = Counter(), Counter(), 0
            for t in b.column(0).to_pylist():
                n += 1
                words = S.words(t)
                have = set(words)
                texts.update(have)
                if len(have & telling) > 1:
                    near.update(beside_filler([w.decode() for w in words]))
            rows = [("", n, 0)] + [(x, c, near[x]) for w, c in texts.items() if (x := w.decode()).isalpha()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "texts", "near"])

    counted = spread(df.select(text).where(F.col(text).isNotNull())).mapInArrow(run, "word string, texts bigint, near bigint").groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("near").alias("near"))
    filler = (F.col("near") >= LEAST_TEXTS) & (F.col("near") >= LEAST_PART * F.col("texts")) & (F.length("word") > 2)
    rows = bounded(counted.where(F.col("word").isin(sorted(own | {""})) | filler).withColumn("filler", filler), MOST_LEARNT + len(own) + 1, "filler of a corpus")
    counts = {r["word"]: r["texts"] for r in rows if r["word"] in own or not r["word"]}
    return counts, counts.pop("", 0), sorted(r["word"] for r in rows if r["filler"])


def labelled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, residue): kind of residue of every row's text, null for descriptions and for null, empty and blank texts."""
    shared = df.sparkSession.sparkContext.broadcast(frequencies(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            labels = [index.label(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string())], ["key", "residue"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"key {kind}, residue string").withColumnRenamed("key", key)
