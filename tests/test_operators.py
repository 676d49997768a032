import datetime
import random

import pytest
from pyspark.sql import functions as F

from plazario.operators import companies, dedupe, labels
from plazario.operators.pairing import sliced
from plazario.sources import pages, store
from plazario.streaming import ingest

D = datetime.date
POSTING = "seq bigint, job_id string, k string, posted_at date, source string, description_text string, li_industries array<string>, li_seniority_field string, company_linkedin_url string, merged_ids array<string>, n_sightings int"


def posting(seq, job, k, day=None, source="guest", text="", url=None):
    return (seq, job, k, day and D(2026, 9, day), source, text, None, None, url, [], 1)


@pytest.mark.parametrize(
    "title,level,role",
    [
        ("Senior Product Designer", "SENIOR", "PRODUCT"), ("Becaria UX/UI", "JUNIOR", "UXUI"), ("Diseñador UX II", "SENIOR", "UX"), ("Head of Design", "LEAD", "OTRO"), ("Diseñador Industrial", "NOT_DESIGN", "OTRO"), ("Contable", "NOT_DESIGN", "OTRO"),
        ("AI Product Designer", "MID", "AI"), ("Junior Senior UX Designer", "SENIOR", "UX"), ("", "NOT_DESIGN", "OTRO"),
    ],
)
def test_labels(spark, title, level, role):
    df = labels.with_level(spark.createDataFrame([(title, None, None)], "t string, d string, f string"), "t", "d", "f")
    r = df.select(F.col("level.label").alias("l"), labels.role(F.col("t"))["label"].alias("r")).first()
    assert (r["l"], r["r"]) == (level, role)


def test_merge_counts_and_backfill(spark):
    rows = [posting(1, "a", "x", 1, url="u"), posting(2, "b", "x", 3), posting(3, "c", "x", 2, text="long"), posting(4, "d", "y", 1), posting(5, "e", "", 1), posting(6, "f", None, 1)]
    df = spark.createDataFrame(rows, POSTING)
    got = {r["job_id"]: r for r in dedupe.merge(df, "k").collect()}
    assert set(got) == {"b", "d", "e", "f"}
    assert got["b"]["merged_ids"] == ["a", "c"] and got["b"]["n_sightings"] == 3 and got["b"]["description_text"] == "long" and got["b"]["company_linkedin_url"] == "u"
    assert sum(r["n_sightings"] for r in got.values()) == len(rows)


def test_merge_does_not_depend_on_partitions(spark):
    random.seed(2)
    rows = [posting(i, f"j{i}", f"k{i % 7 if i % 3 else 0}", random.randint(1, 28), random.choice(["guest", "session"]), "x" * random.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, POSTING)
    want = None
    for n in (1, 3, 8):
        got = sorted((r["job_id"], tuple(r["merged_ids"]), r["n_sightings"]) for r in dedupe.merge(df.repartition(n), "k").collect())
        fold = sorted((r["job_id"], tuple(r["merged_ids"]), r["n_sightings"]) for r in dedupe.fold(df.repartition(n), "k").collect())
        assert want in (None, got) and fold == got
        want = got


def test_title_groups(spark):
    rows = [(1, "c", "m", "senior ux designer"), (2, "c", "m", "senior ux designers"), (3, "c", "m", "accountant"), (4, "d", "m", "senior ux designer")]
    got = {(r["c"], r["t"]): r["title_group"] for r in dedupe.title_groups(spark.createDataFrame(rows, "seq bigint, c string, p string, t string"), "c", "p", "t").collect()}
    assert got["c", "senior ux designers"] == "senior ux designer" and got["c", "accountant"] == "accountant" and got["d", "senior ux designer"] == "senior ux designer"


def test_title_groups_of_a_large_company(spark, monkeypatch):
    from difflib import SequenceMatcher

    rng, titles = random.Random(5), []
    words = "senior junior ux ui designer disenador de interaccion producto research lead web app movil con ingles ref".split()
    for _ in range(150):
        base = " ".join(rng.sample(words, rng.randint(1, 7))) + f" {rng.randrange(10_000)}"
        at = rng.randrange(len(base))
        titles += [base, base[:at] + base[at + 1 :], base[:at] + "x" + base[at:], " ".join(sorted(base.split()))]
    titles = list(dict.fromkeys([*titles, "a" * 300, "a" * 290 + "b" * 10, "\u0142" * 20, "d" * 256 + " e", "f e" * 90]))
    heads, want = [], {}
    for t in titles:
        best = next((h for h in heads if SequenceMatcher(None, h, t).ratio() >= dedupe.FUZZY_TITLE), None)
        if best is None:
            heads.append(t)
        want[t] = t if best is None else best
    compared = []
    monkeypatch.setattr(dedupe, "SequenceMatcher", lambda *a: compared.append(a) or SequenceMatcher(*a))
    assert dict(zip(titles, dedupe.grouped_titles(titles), strict=True)) == want
    # one comparison for each title, nearly
    assert len(compared) < 2 * len(titles)
    df = spark.createDataFrame([(k, "c", "m", t) for k, t in enumerate(titles)], "seq bigint, c string, p string, t string").repartition(3)
    assert {r["t"]: r["title_group"] for r in dedupe.title_groups(df, "c", "p", "t").collect()} == want


def test_sliced_join_is_whole(spark):
    df = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(90)], "k int, v int")
    n = df.groupBy("k").agg(F.count("*").alias("n"))
    both = df.join(n, "k")
    got = sliced(both.toDF("k", "a", "n"), both.toDF("k", "b", "n"), ["k"], "a", "n", slice_rows=4).where("a < b").count()
    assert got == df.alias("l").join(df.alias("r"), F.expr("l.k = r.k and l.v < r.v")).count()


def test_fuzzy_matches_against_brute_force(spark):
    from difflib import SequenceMatcher

    random.seed(3)
    base = ["quimira estudio digital", "berdora workforce", "trevela services", "monlora technologies", "hestisa solutions"]
    names = {b[:i] + random.choice("abcdefg") + b[i + 1 :] for b in base for i in range(0, len(b), 3)} | {"other thing", "short"}
    got = {r["norm"]: r["entry_id"] for r in companies.fuzzy_matches(spark.createDataFrame([(n,) for n in names], "norm string"), spark.createDataFrame(list(enumerate(base)), "entry_id int, norm string")).collect()}
    want = {}
    for n in names:
        best = max(((SequenceMatcher(None, n, b).ratio(), -i) for i, b in enumerate(base)))
        if best[0] >= 0.86 and len(n) >= 6:
            want[n] = -best[1]
    assert got == want


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 0.6, 0.1)], "a double, b double, c double")
    score, strong, weak = companies.weighted([("a", 50, F.col("a")), ("b", 30, F.col("b")), ("c", 20, F.col("c"))])
    assert tuple(df.select(score, strong, weak).first()) == (70.0, ["a", "b"], "c")


def test_fair_cap(spark):
    rows = [("a", 0, 0, 0), ("b", 0, 1, 0), ("a", 0, 1, 1), ("c", 1, 0, 0), ("d", 1, 1, 0)]
    df = spark.createDataFrame(rows, "job_id string, page int, query_order int, position int")
    assert {r["job_id"] for r in store.fair_cap(df, 3).collect()} == {"a", "b", "c"}
    assert store.fair_cap(df, 10).count() == 4


SESSION_PAGE = """<!-- c --><ul><li class="scaffold-layout__list-item" data-occludable-job-id="12345678"><div class="job-card-container" data-job-id="12345678"><a class="job-card-container__link" href="/jobs/view/12345678/?x=1&amp;y=2">
<span aria-hidden='true'>UX  Designer</span></a><div class="artdeco-entity-lockup__subtitle">Vela</div><a href="/company/vela/?trk=1">v</a><img data-delayed-url="https://i/x.png" src="data:,"></div></li></ul>"""


def read(spark, html, how, layout):
    return [r.asDict(recursive=True) for r in how(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html", layout).collect()]


def test_session_page(spark):
    (card,) = read(spark, SESSION_PAGE, pages.extract_cards, pages.SESSION)
    assert (card["job_id"], card["title"], card["company"], card["company_url"], card["company_logo_url"]) == ("12345678", "UX Designer", "Vela", "/company/vela/", "https://i/x.png") and card["parse_warnings"] == []
    assert read(spark, SESSION_PAGE, pages.extract_cards, pages.PUBLIC) == read(spark, None, pages.extract_cards, pages.PUBLIC) == read(spark, "<div <<< >", pages.extract_cards, pages.SESSION) == []


def test_loose_items_and_a_public_page_in_a_session(spark):
    html = "<ul><li class='base-card-x' data-entity-urn='urn:x:777001'><a href='/jobs/view/ux-777001'>UX</a></li><li><a href='/jobs/view/777002/'>no mark</a></li><li data-entity-urn='u:1'>no link</li></ul>"
    (card,) = read(spark, html, pages.extract_cards, pages.PUBLIC)
    assert (card["job_id"], card["title"], card["parse_warnings"]) == ("777001", "UX", ["company not found"])
    (again,) = read(spark, html, pages.extract_cards, pages.SESSION)
    assert again["parse_warnings"] == ["company not found", pages.SESSION_WARNING]


def test_public_detail(spark):
    html = "<div class='description__text'>Hola <b>mundo</b><script>x</script></div><ul><li class='description__job-criteria-item'><h3>Sector</h3><span>Banca, Seguros y Retail</span></li><li class='description__job-criteria-item'><h3>Nivel de antigüedad</h3><span>Prácticas</span></li></ul><a href='/company/vela?x'>v</a>"
    (d,) = read(spark, html, pages.extract_details, pages.PUBLIC)
    assert d["description"] == "Hola mundo" and d["li_industries"] == ["Banca", "Seguros", "Retail"] and d["li_seniority_field"] == "Prácticas" and d["company_slug"] == "vela" and d["criteria"]["sector"] == "Banca, Seguros y Retail"
    assert read(spark, "", pages.extract_details, pages.PUBLIC)[0]["parse_warnings"] == ["description not found"]


def test_session_detail(spark):
    html = "<div id='job-details'>Texto</div><span class='job-details-jobs-unified-top-card__job-insight'>Jornada · Nivel inicial</span><span class='jobs-unified-top-card__job-insight'>Sectores: Banca; Retail</span>"
    (d,) = read(spark, html, pages.extract_details, pages.SESSION)
    assert (d["description"], d["li_seniority_field"], d["li_industries"]) == ("Texto", "Nivel inicial", ["Banca", "Retail"])


def test_overlay_takes_only_what_holds_something(spark):
    cards = spark.createDataFrame([("1", "own", ["a"], ["w"]), ("2", "own", ["a"], [])], "job_id string, title string, li_industries array<string>, parse_warnings array<string>")
    details = spark.createDataFrame([("1", "", [], "text", ["d"])], "job_id string, title string, li_industries array<string>, description string, parse_warnings array<string>")
    got = {r["job_id"]: r.asDict() for r in pages.overlay(cards, details).collect()}
    assert (got["1"]["title"], got["1"]["li_industries"], got["1"]["description"], got["1"]["parse_warnings"]) == ("own", ["a"], "text", ["w", "d"])
    assert got["2"]["parse_warnings"] == ["detail not found"] and got["2"]["description"] is None


def test_recorded_pages(spark, tmp_path):
    import hashlib

    name = hashlib.sha1(b"https://x/1").hexdigest()
    (tmp_path / f"{name}.html").write_text(SESSION_PAGE)
    urls = spark.createDataFrame([("https://x/1",), ("https://x/2",)], "url string")
    got = {r["url"]: r["html"] for r in pages.recorded(pages.read_pages(spark, str(tmp_path)), urls).collect()}
    assert got["https://x/1"] == SESSION_PAGE and got["https://x/2"] is None


def test_raw_layer(spark, tmp_path):
    df = spark.createDataFrame([(1, "20260101-000000", "a"), (2, "20260102-000000", "b")], "seq bigint, run_id string, job_id string")
    store.save_raw(df, str(tmp_path))
    assert [r["job_id"] for r in store.load_raw(spark, str(tmp_path)).collect()] == ["b"]
    store.append_seen(df, str(tmp_path))
    assert store.unseen(df, spark.read.parquet(str(tmp_path / "seen"))).count() == 0


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("a", datetime.datetime(2026, 1, 1)), ("a", datetime.datetime(2026, 1, 2)), ("b", None), ("b", datetime.datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "job_id string, fetched_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.arrivals(spark, str(tmp_path / "in"), "job_id string, fetched_at timestamp"))
    q = ingest.run_batches(stream, str(tmp_path / "cp"), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")))
    q.awaitTermination()
    assert sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
