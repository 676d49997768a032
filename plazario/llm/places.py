"""Free-entered places mapped to a reference list (BK-tree under a true edit metric).

The reference names and their other names go into a BK-tree that every worker builds once from a broadcast of the list; a list above
MOST_ENTRIES is cut into shards, each with its own tree; every shard answers with all its entries within the radius, the answers are merged and the same rules read them, so the result is the same.  A value is read segment by
segment (commas, slashes, brackets, dashes): the whole segment exactly, then within the edit radius of its length, then with the words
of direction and decoration taken off its ends, then any run of its words exactly.  Of several places the one that is not merely
the province of another wins.  A value read before is remembered by the worker, so frequent values cost one lookup and nothing is shuffled.

Defined results: null and empty values give no row in ``found`` and null in ``mapped``; blank values and values without an entry give place 0.
Ties go to the smaller distance, the longer name, the smaller place_id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazario.common import TooManyRows, bounded, durable
from plazario.llm.edits import BKTree
from plazario.llm.plain import plain
from plazario.operators.pairing import looked_up

#: Reference names of one tree; beyond, the list is sharded.
MOST_ENTRIES = 20_000
#: Values a worker remembers; past it the store starts afresh.
REMEMBERED = 1 << 17
#: Segments of more words are not looked up whole: their exact runs are, and if there is none their misspelt runs.
MOST_SEGMENT_WORDS = 12

#: Words around a place that do not name it.
AROUND = set(
    "zona area de del greater metropolitan metropolitana y e alrededores cerca centro provincia ciudad city region near around in en "
    "hibrido hibrida hybrid presencial onsite on site office oficina oficinas dia dias semana viajes puntuales remoto remota remote "
    "teletrabajo comunidad urban norte sur este oeste flexible parcial casa desde toda todo todos la el los las and".split()
)
#: Names of countries as people write them, to the code of the list.
COUNTRIES = {
    "espana": "ES", "spain": "ES", "es": "ES", "portugal": "PT", "pt": "PT", "alemania": "DE", "germany": "DE", "deutschland": "DE", "de": "DE",
    "francia": "FR", "france": "FR", "fr": "FR", "reino unido": "GB", "united kingdom": "GB", "uk": "GB", "gb": "GB", "inglaterra": "GB", "england": "GB",
    "italia": "IT", "italy": "IT", "it": "IT", "suiza": "CH", "switzerland": "CH", "suisse": "CH", "schweiz": "CH", "ch": "CH",
    "paises bajos": "NL", "holanda": "NL", "nederland": "NL", "netherlands": "NL", "the netherlands": "NL", "nl": "NL", "andorra": "AD", "ad": "AD",
}
#: Words for work from anywhere within a country, and what they are read as.
_ALIKE = {"remote": "remoto", "remota": "remoto", "teletrabajo": "remoto", "spain": "espana", "es": "espana"}
_FILLING = {"en", "desde", "toda", "todo", "la", "el", "de", "100", "trabajo", "work", "working", "from", "job", "empleo", "in", "solo", "only"}

_SEGMENTS = regex.compile(r"[,;/|()\[\]·\n]+|\s[-–—]+\s|\s[-–—]+$|^[-–—]+\s")
_RUNS = regex.compile(r"[a-z0-9]+")
_MARKS = regex.compile(r"\p{M}+")


def fold(text: str) -> str:
    """Lower-case letters and digits without accents, single blanks between runs."""
    text = _MARKS.sub("", unicodedata.normalize("NFKD", plain(text))).lower()
    return " ".join(_RUNS.findall(text))


def radius(key: str) -> int:
    """Edits allowed in a name of this length."""
    n = len(key.replace(" ", ""))
    return 0 if n < 4 else 1 if n < 9 else 2


def bag(words: list[str]) -> str:
    """Words of a remote place in one order and one language."""
    return " ".join(sorted({_ALIKE.get(w, w) for w in words} - _FILLING))


class Reader:
    """The rules by which a value is read, over the answers of one tree or of many."""

    def __init__(self, longest: int):
        """``longest``: most words of a reference name."""
        self.longest = longest
        self.memory: dict[str, tuple[int, int]] = {}

    def place(self, key: str) -> int | None:
        """The place of a name, exactly."""
        raise NotImplementedError

    def within(self, key: str) -> list[tuple[int, str]]:
        """Names within the radius of ``key``, as (distance, name)."""
        raise NotImplementedError

    def province(self, place: int) -> str:
        """The folded province of a place."""
        raise NotImplementedError

    def is_remote(self, place: int) -> bool:
        """Whether a place stands for work from anywhere."""
        raise NotImplementedError

    def remote(self, key: str) -> tuple[int, int] | None:
        """(place, distance) of the remote place nearest to a bag of words."""
        raise NotImplementedError

    def near(self, key: str) -> tuple[int, str] | None:
        """The nearest name within the radius: (distance, name)."""
        if self.place(key) is not None:
            return 0, key
        hits = [h for h in self.within(key) if len(h[1]) >= 4] if radius(key) else []
        return min(hits, key=lambda h: (h[0], -len(h[1]), self.place(h[1]))) if hits else None

    @staticmethod
    def trimmed(words: list[str]) -> Iterator[str]:
        """A segment as it is, then with one word around a place after another taken off its ends."""
        inner = list(words)
        while True:
            yield " ".join(inner)
            if inner and inner[-1] in AROUND:
                inner = inner[:-1]
            elif inner and inner[0] in AROUND:
                inner = inner[1:]
            elif len(inner) > 1 and inner[-1] in COUNTRIES:
                inner = inner[:-1]
            elif len(inner) > 1 and inner[0] in COUNTRIES:
                inner = inner[1:]
            else:
                return

    def runs(self, words: list[str], most: int) -> Iterator[list[str]]:
        """Runs of so many words, longest first, as one list for each length."""
        for n in range(min(self.longest, most, len(words)), 0, -1):
            yield list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))

    def segment(self, words: list[str]) -> list[tuple[int, str]]:
        """Names in a segment, as (distance, name), in the order of the text."""
        words = [w for w in words if not w.isdigit()]
        if not words or " ".join(words) in COUNTRIES:
            return []
        if len(words) <= MOST_SEGMENT_WORDS:
            for key in self.trimmed(words):
                if hit := self.near(key):
                    return [hit]
        out, i = [], 0
        while i < len(words):  # exact runs, longest first
            for n in range(min(self.longest, len(words) - i), 0, -1):
                key = " ".join(words[i : i + n])
                if len(key) > 2 and self.place(key) is not None:
                    out.append((0, key))
                    i += n - 1
                    break
            i += 1
        if not out and len(words) > MOST_SEGMENT_WORDS:  # misspelt runs, longest first; shorter segments were asked whole
            for keys in self.runs(words, MOST_SEGMENT_WORDS):
                hits = [h for k in keys if len(k) > 3 and (h := self.near(k))]
                if hits:
                    return [min(hits, key=lambda h: h[0])]
        return out

    @staticmethod
    def parts(value: str) -> list[list[str]]:
        """The words of each segment of a plain value."""
        return [p for p in (fold(x).split() for x in _SEGMENTS.split(value) if x) if p]

    def asked(self, value: str) -> dict[str, int]:
        """Every key that reading the value may ask for: 0 exactly, 1 within the radius, and bags of words (2)."""
        value = plain(value)
        out = {fold(value): 0}
        parts = self.parts(value)
        for words in parts:
            words = [w for w in words if not w.isdigit()]
            if len(words) <= MOST_SEGMENT_WORDS:
                out |= dict.fromkeys(self.trimmed(words), 1)
            for keys in self.runs(words, len(words)):
                out |= {k: 1 for k in keys if len(words) > MOST_SEGMENT_WORDS and k.count(" ") < MOST_SEGMENT_WORDS} | {k: 0 for k in keys if k not in out and (len(words) <= MOST_SEGMENT_WORDS or k.count(" ") >= MOST_SEGMENT_WORDS)}
        key = bag([w for p in parts for w in p])
        return {k: how for k, how in out.items() if k} | ({"\x00" + key: 2} if key else {})

    def read(self, value: str) -> tuple[int, int]:
        """(place_id, distance) of a value; place 0 if the list has no entry for it."""
        known = self.memory.get(value)
        if known is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            known = self.memory[value] = self._read(value)
        return known

    def _read(self, value: str) -> tuple[int, int]:
        value = plain(value)
        if (place := self.place(fold(value))) is not None:
            return place, 0
        parts = self.parts(value)
        hits = [h for p in parts for h in self.segment(p)]
        hits = [h for h in hits if not self.is_remote(self.place(h[1]))] or hits
        if hits:
            places = {self.place(k) for _, k in hits}
            provinces = {self.province(p) for p in places}
            towns = [h for h in hits if not (h[1] in provinces and any(self.province(p) == h[1] for p in places - {self.place(h[1])}))]
            if towns:
                best = min(towns, key=lambda h: h[0]) if all(h[0] for h in towns) else next(h for h in towns if h[0] == 0)
                return self.place(best[1]), best[0]
            best = min(hits)
            return self.place(best[1]), best[0]
        key = bag([w for p in parts for w in p])
        return (key and self.remote(key)) or (0, 0)


def keys_of(row: tuple) -> Iterator[tuple[str, int]]:
    """Keys of a reference row (place_id, name, other names, province, country): names (0), names with initials (1), bags of remote places (2)."""
    for x in [row[1], *(row[2] or [])]:
        key = fold(x or "")
        if key:
            words = key.split()
            yield key, 0
            if {_ALIKE.get(w, w) for w in words} & {"remoto"}:
                yield bag(words), 2
            for short in shortened(words):
                yield short, 1


def shortened(words: list[str]) -> set[str]:
    """A name of several words with some of its long words as initials ("p de alarcon")."""
    out, long = set(), [i for i, w in enumerate(words) if len(w) > 3]
    if len(words) > 1 and len(long) <= 4:
        for chosen in range(1, 1 << len(long)):
            short = [w[0] if i in long and chosen >> long.index(i) & 1 else w for i, w in enumerate(words)]
            if any(len(w) > 3 for w in short) or len(long) == 1 and len(words) > 2:
                out.add(" ".join(short))
    return out


def treed(key: str) -> bool:
    """Whether a key is long enough to be met by a misspelling."""
    return len(key.replace(" ", "")) >= 4


class Gazetteer(Reader):
    """The whole reference list with its tree."""

    def __init__(self, rows: list[tuple]):
        """``rows``: place_id, name, other names, province, country."""
        self.ids: dict[str, int] = {}
        self.remotes: dict[str, int] = {}
        self.provinces = {r[0]: fold(r[3] or "") for r in sorted(rows, key=str)}
        initials: dict[str, set[int]] = {}
        for row in sorted(rows, key=lambda r: r[0]):
            for key, kind in keys_of(row):
                if kind == 1:
                    initials.setdefault(key, set()).add(row[0])
                else:
                    (self.remotes if kind else self.ids).setdefault(key, row[0])
        for short, places in initials.items():
            if len(places) == 1:
                self.ids.setdefault(short, *places)
        super().__init__(max((len(k.split()) for k in self.ids), default=0))
        self.tree, self.remote_tree = BKTree(sorted(filter(treed, self.ids))), BKTree(sorted(self.remotes))
        self.remote_places = set(self.remotes.values())

    def place(self, key):
        return self.ids.get(key)

    def within(self, key):
        return self.tree.within(key, radius(key))

    def province(self, place):
        return self.provinces[place]

    def is_remote(self, place):
        return place in self.remote_places

    def remote(self, key):
        near = self.remote_tree.within(key, min(1, radius(key)))
        return (self.remotes[near[0][1]], near[0][0]) if near else None


class Merged(Reader):
    """What all shards answered to the keys of one value."""

    def __init__(self, longest: int, answers: list[dict]):
        """``answers``: key, how, distance, name, place_id, province, remote."""
        super().__init__(longest)
        self.ids = {a["name"]: a["place_id"] for a in answers if a["how"] < 2}
        self.facts = {a["place_id"]: (a["province"], a["remote"]) for a in answers}
        self.near_of: dict[str, list[tuple[int, str]]] = {}
        self.bags: dict[str, list[tuple[int, str, int]]] = {}
        for a in answers:
            if a["how"] == 2:
                self.bags.setdefault(a["key"], []).append((a["distance"], a["name"], a["place_id"]))
            elif a["how"] == 1:
                self.near_of.setdefault(a["key"], []).append((a["distance"], a["name"]))

    def place(self, key):
        return self.ids.get(key)

    def within(self, key):
        return self.near_of.get(key, [])

    def province(self, place):
        return self.facts[place][0]

    def is_remote(self, place):
        return self.facts[place][1]

    def remote(self, key):
        near = min(self.bags.get(key, []), default=None)
        return near and (near[2], near[0])


def _reference(places: DataFrame, most: int) -> list[tuple]:
    rows = bounded(places.select("place_id", "place_name", "alt_names", "province", "country"), most, "places")
    return [tuple(r) for r in rows if r[0] is not None]


def _mapped(df: DataFrame, rows: list[tuple], key: str, value: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rows)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gazetteer(shared.value)
        for b in batches:
            read = [g.read(v) if v else (None, None) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in read], pa.int32()), pa.array([x[1] for x in read], pa.int32())], ["key", "value", "place_id", "distance"])

    return df.select(F.col(key), F.col(value)).mapInArrow(run, f"key {kind}, value string, place_id int, distance int")


def entries(places: DataFrame) -> DataFrame:
    """(name, kind, place_id, province, remote): the keys of a reference list of any size, each with its place: names before initials, the smallest place_id, initials only if one place has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, kind, r["place_id"], fold(r["province"] or "")) for r in b.to_pylist() for k, kind in keys_of((r["place_id"], r["place_name"], r["alt_names"]))]
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["name", "kind", "place_id", "province"])

    listed = places.where("place_id is not null").select(F.col("place_id").cast("int"), "place_name", "alt_names", "province")
    keys = listed.mapInArrow(run, "name string, kind int, place_id int, province string")
    named = keys.where("kind < 2").groupBy("name").agg(F.min(F.struct("kind", "place_id", "province")).alias("w"), F.min("place_id").alias("least"), F.max("place_id").alias("most"), F.min("kind").alias("k"))
    named = named.where("k = 0 or least = most").select("name", F.lit(0).alias("kind"), "w.place_id", "w.province")
    bags = keys.where("kind = 2").groupBy("name").agg(F.min(F.struct("place_id", "province")).alias("w")).select("name", F.lit(2).alias("kind"), "w.place_id", "w.province")
    remote = bags.select("place_id").distinct().withColumn("remote", F.lit(True))
    return named.unionByName(bags).join(remote, "place_id", "left").select("name", "kind", "place_id", "province", F.coalesce("remote", F.lit(False)).alias("remote"))


_ANSWER = "key string, how int, distance int, name string, place_id int, province string, remote boolean"


def _answers(asked: DataFrame, shard: list[tuple]) -> DataFrame:
    """What the entries of one shard answer to (key, how)."""
    shared = asked.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {r[0]: r[2:] for r in shared.value if r[1] == 0}
        bags = {r[0]: r[2:] for r in shared.value if r[1] == 2}
        tree, bag_tree = BKTree(sorted(filter(treed, names))), BKTree(sorted(bags))
        for b in batches:
            out = []
            for key, how in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if how == 2:
                    out += [(key[1:], 2, d, n, *bags[n]) for d, n in bag_tree.within(key[1:], min(1, radius(key[1:])))]
                    continue
                if key in names:
                    out.append((key, 0, 0, key, *names[key]))
                if how == 1 and (r := radius(key)):
                    out += [(key, 1, d, n, *names[n]) for d, n in tree.within(key, r)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "how", "distance", "name", "place_id", "province", "remote"])

    return asked.mapInArrow(run, _ANSWER)


def _sharded(df: DataFrame, places: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """As one tree: every shard answers every key with all its entries within the radius, and the rules are applied once, to the merged answers.

    The values are read once, as distinct values; the shards see distinct keys only.
    """
    reference = durable(entries(places))
    n = -(-reference.count() // most)
    longest = reference.where("kind = 0").agg(F.max(F.size(F.split("name", " ")))).first()[0] or 0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(longest)
        for b in batches:
            out = [(v, k, how) for v in b.column(0).to_pylist() for k, how in reader.asked(v).items()]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["value", "key", "how"])

    values = durable(df.select(F.col(value).alias("value")).where(F.length("value") > 0).distinct())
    asked = durable(values.mapInArrow(ask, "value string, key string, how int"))
    keys = durable(asked.groupBy("key").agg(F.max("how").alias("how")))
    told = None
    for s in range(n):  # one tree of bounded size after another
        shard = [tuple(r) for r in bounded(reference.where(F.pmod(F.xxhash64("name"), F.lit(n)) == s), 2 * most + 64, "shard of places")]
        part = _answers(keys, shard)
        told = part if told is None else told.unionByName(part)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Merged(longest, a).read(v) for v, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int32())], ["value", "place_id", "distance"])

    told = asked.withColumn("key", F.when(F.col("how") == 2, F.expr("substring(key, 2)")).otherwise(F.col("key"))).withColumnRenamed("how", "asked").join(told, "key").where((F.col("asked") == 2) == (F.col("how") == 2))
    answers = told.groupBy("value").agg(F.collect_list(F.struct("key", "how", "distance", "name", "place_id", "province", "remote")).alias("answers"))
    won = answers.mapInArrow(read, "value string, place_id int, distance int")
    full = values.join(won, "value", "left").select("value", F.coalesce("place_id", F.lit(0)).alias("place_id"), F.coalesce("distance", F.lit(0)).alias("distance"))
    rows = df.groupBy(F.col(value).alias("value")).count()
    return looked_up(df.select(F.col(key).alias("key"), F.col(value).alias("value")), full.join(rows, "value"), ["value"], "count").select("key", "value", "place_id", "distance").unionByName(
        df.where(F.coalesce(F.length(value), F.lit(0)) == 0).select(F.col(key).alias("key"), F.col(value).alias("value"), F.lit(None).cast("int").alias("place_id"), F.lit(None).cast("int").alias("distance"))
    )


def mapped(df: DataFrame, places: DataFrame, key: str, value: str, most: int = MOST_ENTRIES) -> DataFrame:
    """(key, value, place_id, distance) of every row of ``df``; place_id 0 where the list has no entry, null for null and empty values.

    A list of more than ``most`` rows is sharded, with the same result.
    """
    try:
        return _mapped(df, _reference(places, most), key, value)
    except TooManyRows:
        return _sharded(df, places, key, value, most)


def found(df: DataFrame, places: DataFrame, key: str, value: str, most: int = MOST_ENTRIES) -> DataFrame:
    """(key, place_id) of the rows whose value is not empty and not, character for character, a place name of the list."""
    names = places.select(F.col("place_name").alias("value")).where("value is not null").distinct()
    return mapped(df, places, key, value, most).where("place_id is not null").join(names, "value", "left_anti").select(F.col("key").alias(key), "place_id")
