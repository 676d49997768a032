"""Variant spellings of company names linked to a list of companies (MinHash banding, Monge-Elkan, star clustering).

A name is brought to plain form and cut into tokens.  The tokens of all distinct names and the telling tokens ("heads") of the listed companies are
banded by MinHash over padded q-grams; the number of bands follows from the collision curve, so that a token at
LEAST_SIMILARITY still collides with probability RECALL.  Names and companies that meet in a band are verified by Monge-Elkan: every
token of the name takes its best partner among the company's tokens (equal, misspelt, abbreviated), and the score is their mean.  Each company is the
centre of a star; a name joins the star of its best centre.  Companies that must not be mistaken for a listed one take part as centres of their own.

Defined results: null and blank names link to nothing; blank, null and repeated aliases are ignored; ties go to the smaller entry_id; a name that
fits a listed and another company equally well links to neither.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazario.common import bounded, durable, partitions
from plazario.llm.edits import edit_distance
from plazario.llm.plain import plain
from plazario.llm.shingles import mix
from plazario.operators.pairing import looked_up

#: Length of the q-grams and rows of a band.
Q, ROWS = 2, 3
#: The collision curve is tuned so that tokens of this similarity meet with this probability.
LEAST_SIMILARITY, RECALL = 0.4, 0.99
#: Companies of one index, listed and others together; a longer list is sharded.
MOST_COMPANIES = 20_000
#: Least similarity of a token and its partner, and of a name and its centre.
LEAST_TOKEN, LEAST_SCORE = 0.7, 0.74

#: Legal forms, and words of place and region that people add to a company's name.
LEGAL = set("sl slu sa sau slp sll sc srl sas spa ltd limited llc llp inc corp corporation co company gmbh ag plc bv nv lda cia sociedad limitada anonima unipersonal".split())
ADDED = set(
    "espana spain es europe europa emea iberia iberica madrid barcelona valencia sevilla bilbao oficina oficinas office norte sur este oeste centro sede delegacion "
    "global international internacional portugal france francia latam uk branch sucursal north south east west hq group grupo the".split()
)
#: Abbreviations that do not follow from the word.
USUAL = {"xp": "experience", "ux": "experience", "it": "informatica", "rrhh": "humanos", "hr": "humanos"}
_SPLIT = regex.compile(r"(?<=\p{Ll}{2})(?=\p{Lu}\p{Ll}{2})")
_RUNS = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{M}+")


def bands(similarity: float = LEAST_SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands that the collision curve 1 - (1 - s**rows)**bands needs to reach ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


_BANDS = bands()
_TIMES = (mix(np.arange(1, _BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
_NUMBER = mix(np.arange(101, 101 + _BANDS, dtype=np.uint64))


@cache
def _cleaned(word: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", word)).lower()


def tokens(name: str) -> list[str]:
    """Tokens of a name: glued words apart, dotted initials together, no accents and case."""
    out: list[str] = []
    single = False
    for w in _RUNS.findall(_SPLIT.sub(" ", unicodedata.normalize("NFC", plain(name)))):
        w = _cleaned(w)
        if len(w) == 1 and single:
            out[-1] += w
        elif w:
            out.append(w)
        single = len(w) == 1
    return out


def band_keys(token: str) -> np.ndarray:
    """One 64-bit key for each band of a token's padded q-grams."""
    padded = "\x02" * (Q - 1) + token + "\x03" * (Q - 1)
    grams = np.array([xxhash.xxh3_64_intdigest(padded[i : i + Q]) for i in range(len(padded) - Q + 1)], np.uint64)
    least = mix(grams[None, :] * _TIMES).min(axis=1).reshape(_BANDS, ROWS)
    key = _NUMBER.copy()
    for r in range(ROWS):
        key = mix(key ^ least[:, r] * np.uint64(2 * r + 3))
    return key


def abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` stands for ``full``: its beginning, its beginning and a plural s, its initial doubled, or its consonants in order."""
    if USUAL.get(short) == full:
        return True
    if len(short) >= len(full) or short[0] != full[0]:
        return False
    if full.startswith(short) or len(short) > 2 and short[-1] == "s" and full.startswith(short[:-1]) or len(short) == 2 and short[0] == short[1]:
        return True
    rest = iter(full)
    return len(short) <= 5 and not set(short[1:]) & set("aeiou") - set(short[-1]) and all(c in rest for c in short)


def few_edits(a: str, b: str, most: int) -> int:
    """Edit distance of two tokens, or ``most`` + 1 when it is larger: letters that one has and the other lacks are counted first."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    extra = sum(max(0, a.count(c) - b.count(c)) for c in set(a))
    if max(extra, extra + len(b) - len(a)) > most:
        return most + 1
    return edit_distance(a, b)


@lru_cache(1 << 18)
def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, 0.9 for an abbreviation, else 1 - edits / length where the edits are few for the length."""
    if a == b:
        return 1.0
    if len(a) > 3 and a[-1] == "s" and a[:-1] == b or len(b) > 3 and b[-1] == "s" and b[:-1] == a:
        return 0.95
    if abbreviates(a, b):
        return 0.9
    n = max(len(a), len(b))
    most = 0 if n < 5 else 1 if n < 8 else 2
    d = few_edits(a, b, most)
    return 1 - d / n if d <= most else 0.0


@lru_cache(1 << 18)
def head_similarity(a: str, b: str) -> float:
    """Similarity of a token and a head: misspelt, never abbreviated."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    most = 0 if n < 5 else 1 if n < 7 else 2
    d = few_edits(a, b, most)
    return 1 - d / n if d <= most else 0.0


class Companies:
    """The centres: tokens and heads of every company, and how many companies use a token."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], users: dict[str, int] | None = None, head_users: dict[str, int] | None = None):
        """``rows``: number (negative for companies that are not listed), name, aliases; of a shard the counts over all companies are given."""
        self.pool: dict[int, dict[str, None]] = {}
        self.forms: dict[int, list[list[str]]] = {}
        for number, name, aliases in rows:
            forms = [t for x in [name, *(aliases or [])] if x and (t := [w for w in tokens(x) if w not in LEGAL])]
            if forms:
                self.forms[number] = forms
                self.pool[number] = dict.fromkeys(w for f in forms for w in f)
        self.users = users or Counter(w for p in self.pool.values() for w in p)
        self.heads = {n: list(dict.fromkeys(self.head(f) for f in forms)) for n, forms in self.forms.items()}
        self.head_users = head_users or Counter(h for hs in self.heads.values() for h in hs)

    def head(self, form: list[str]) -> str:
        """The telling token of a name: the one fewest companies use, the longest of these; no word of place or group if there is another."""
        return min([w for w in form if w not in ADDED] or form, key=lambda w: (self.users[w], -len(w)))

    def keys(self) -> Iterator[tuple[int, int]]:
        """(band key, company) of every head and every form written as one word."""
        for n, forms in self.forms.items():
            for word in {*self.heads[n], *("".join(f) for f in forms)}:
                for k in band_keys(word).view(np.int64).tolist():
                    yield k, n

    def _glued(self, whole: str, number: int) -> float:
        """Score of a name written as one word, or with blanks in other places."""
        if len(whole) < 8:
            return 0.0
        s = max(token_similarity(whole, "".join(f)) for f in self.forms[number])
        return 0.98 * s if s >= 0.88 else 0.0

    def score(self, name: list[str], number: int) -> float:
        """Monge-Elkan score of a name's tokens against a company, 0 if no head is in the name or a token has no partner."""
        own = [w for w in name if w not in LEGAL]
        whole = "".join(own)
        pool, heads = self.pool[number], self.heads[number]
        best_head, at = max(((head_similarity(w, h), i) for i, w in enumerate(own) for h in heads), default=(0.0, 0))
        if best_head < LEAST_TOKEN:
            return self._glued(whole, number)
        parts, plainly = [best_head], True
        for i, w in enumerate(own):
            if i == at:
                continue
            s = max(token_similarity(w, p) for p in pool)
            if s < LEAST_TOKEN:
                if w in ADDED:
                    continue
                return self._glued(whole, number)
            plainly = False
            parts.append(s)
        # a head alone tells only if it is no other company's
        if plainly and any(self.head_users[h] > 1 for h in heads if head_similarity(own[at], h) == best_head):
            return 0.0
        # how much of the company's name is covered breaks ties between companies of one head
        covered = max(sum(any(token_similarity(w, p) >= LEAST_TOKEN for w in own) for p in f) / len(f) for f in self.forms[number])
        return sum(parts) / len(parts) - 0.02 * (1 - covered)


class Bands:
    """The companies' bands as sorted arrays, and the names' way through them."""

    MOST_TOKENS = 1 << 16

    def __init__(self, companies: Companies):
        self.companies = companies
        pairs = sorted(set(companies.keys()))
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.numbers = np.array([n for _, n in pairs], np.int64)
        self.memory: dict[str, frozenset[int]] = {}

    def met(self, token: str) -> frozenset[int]:
        """Companies that share a band with a token; remembered for frequent tokens."""
        hit = self.memory.get(token)
        if hit is None:
            if len(self.memory) >= self.MOST_TOKENS:
                self.memory.clear()
            keys = band_keys(token).view(np.int64)
            lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            hit = self.memory[token] = frozenset(int(x) for i, j in zip(lo, hi, strict=True) if i < j for x in self.numbers[i:j])
        return hit

    def centre(self, name: str) -> tuple[int, float] | None:
        """(entry, score) of the listed company whose star a name joins; None if there is none, or another company is as near."""
        best = self.nearest(name)
        return best if best and best[0] >= 0 else None

    def nearest(self, name: str) -> tuple[int, float] | None:
        """(number, score) of the nearest company, listed or not; on equal scores the one not listed, then the smaller number."""
        own = tokens(name)
        words = [w for w in own if w not in LEGAL]
        # a short word only if it is some company's head: its own bands find it
        met = {c for w in {*(w for w in words if len(w) > 2 or w in self.companies.head_users), "".join(words)} if w for c in self.met(w)}
        scores = [(s, c < 0, -c, c) for c in met if (s := self.companies.score(own, c)) >= LEAST_SCORE]
        best = max(scores, default=None)
        return (best[3], best[0]) if best else None


def _companies(listed: DataFrame, others: DataFrame | None) -> DataFrame:
    """(number, name, aliases) of listed companies and, with negative numbers, of others."""
    rows = listed.select(F.col("entry_id").cast("bigint").alias("number"), "name", "aliases").where("number is not null")
    if others is None:
        return rows
    # equal rows of the other list are one company; its number only has to be its own
    other = others.select("name", "aliases").distinct().select((-1 - F.pmod(F.xxhash64("name", "aliases"), F.lit(1 << 52))).alias("number"), "name", "aliases")
    return rows.unionByName(other)


def _told(companies: DataFrame, what: Callable[[Companies], dict[int, Iterable[str]]], users: dict[str, int] | None = None) -> DataFrame:
    """(number, word) of what each company by itself has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, w) for n, ws in what(Companies([tuple(r.values()) for r in b.to_pylist()], users)).items() for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([w for _, w in got], pa.string())], ["number", "word"])

    return companies.mapInArrow(run, "number bigint, word string").distinct()


def _shards(companies: DataFrame, most: int) -> Iterator[tuple[list[tuple], dict[str, int] | None, dict[str, int] | None]]:
    """Rows of each shard with the counts over all companies that its own tokens and heads need; one shard is in the driver at a time."""
    n = companies.count()
    if n <= most:
        yield [tuple(r) for r in companies.collect()], None, None
        return
    shards = -(-n // most)
    parts = [companies.where(F.pmod(F.xxhash64("number"), F.lit(shards)) == s) for s in range(shards)]
    words = durable(_told(companies, lambda c: c.pool))
    users = durable(words.groupBy("word").agg(F.count("*").alias("n")))

    def of(counts: DataFrame, own: DataFrame) -> dict[str, int]:
        return {r["word"]: r["n"] for r in bounded(counts.join(own.select("word").distinct(), "word", "left_semi"), 64 * most, "words of a shard of companies")}

    heads = None
    for part in parts:
        own = _told(part, lambda c: c.heads, of(users, words.join(part.select("number"), "number", "left_semi")))
        heads = own if heads is None else heads.unionByName(own)
    heads = durable(heads.distinct())
    head_users = durable(heads.groupBy("word").agg(F.count("*").alias("n")))
    for part in parts:
        rows = bounded(part, 2 * most + 64, "shard of companies")
        yield [tuple(r) for r in rows], of(users, words.join(part.select("number"), "number", "left_semi")), of(head_users, heads)


def stars(names: DataFrame, listed: DataFrame, others: DataFrame | None = None, most: int = MOST_COMPANIES) -> DataFrame:
    """(name, entry_id, score): each name of ``names`` (one column, distinct) with the listed company whose star it belongs to.

    With more than ``most`` companies every shard tells its nearest one and the best of these wins, which is the same.
    """
    # few bytes but much work: adaptive planning would put them into one task
    spread = names.toDF("name").repartition(max(partitions(names.sparkSession), names.sparkSession.sparkContext.defaultParallelism))
    told = None
    for shard in _shards(_companies(listed, others), most):
        shared = names.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Bands(Companies(*shared.value))
            for b in batches:
                found = [index.nearest(n) for n in b.column(0).to_pylist()]
                kept = [i for i, f in enumerate(found) if f]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(kept, pa.int32())), pa.array([found[i][0] for i in kept], pa.int64()), pa.array([found[i][1] for i in kept], pa.float64())], ["name", "number", "score"]
                )

        part = spread.mapInArrow(run, "name string, number bigint, score double")
        told = part if told is None else told.unionByName(part).groupBy("name").agg(F.max(F.struct("score", (F.col("number") < 0).alias("other"), (-F.col("number")).alias("least"))).alias("w")).select("name", (-F.col("w.least")).alias("number"), "w.score")
    return told.where("number >= 0").select("name", F.col("number").cast("int").alias("entry_id"), "score")


def variants(df: DataFrame, name: str, listed: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """``df`` with entry_id and score of the rows whose ``name`` is a variant of a listed company, other than a listed spelling itself."""
    spellings = listed.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), F.col("entry_id").alias("own")).where("name is not null").distinct()
    rows = df.select(F.col(name).alias("name")).where(F.trim(F.coalesce("name", F.lit(""))) != "").groupBy("name").agg(F.count("*").alias("rows"))
    linked = stars(rows.select("name"), listed, others).join(spellings, ["name"], "left").where("own is null or own <> entry_id").drop("own").distinct()
    # one name may have a good part of all rows
    return looked_up(df.withColumn("linked name", F.col(name)), linked.join(rows, "name").withColumnRenamed("name", "linked name"), ["linked name"], "rows").drop("linked name", "rows")
