import datetime

from pyspark.sql import functions as F

from plazario.plans import pipeline
from plazario.sources import report

TODAY = datetime.date(2026, 9, 4)
RAW = (
    "seq bigint, job_id string, source string, title string, company string, company_url string, location string, posted_text string, posted_iso string, workplace_type string, description string, li_seniority_field string, "
    "li_industries array<string>, parse_warnings array<string>"
)


def row(seq, job, title, company, location="Madrid", source="guest", text="", ago="hace 2 días", iso=None, url=None):
    return (seq, job, source, title, company, url, location, ago, iso, None, text, None, [], [])


ROWS = [
    row(1, "1", "Junior Product Designer", "Vela Health, S.L."), row(2, "1", "Junior Product Designer", "Vela Health, S.L.", source="session", text="más texto"), row(3, "2", "Product Designer Junior (H/M)", "Vela Health"),
    row(4, "3", "UX Designer", "Estudio <Marea>", url="https://x/company/marea/?a=1"), row(5, "4", "Diseñador Industrial", "Nube"), row(6, "5", "", None, location=None), row(7, "6", "Lead UX Designer", "Nube", iso="2026-09-01"),
]


def run(spark, n=1):
    raw = spark.createDataFrame(ROWS, RAW).repartition(n)
    return pipeline.process(pipeline.postings_of(raw, F.lit(TODAY)), F.lit(TODAY))


def test_every_posting_leaves_by_one_route(spark):
    r = run(spark)
    got = r.reconcile().first()
    assert got["balanced"] and got["seen"] == len(ROWS) and got["merged"] == 2 and got["filtered"] == 2
    assert {x["job_id"] for x in r.filtered.collect()} == {"4", "5"}


def test_partitions_do_not_matter(spark):
    rows = [sorted(map(str, run(spark, n).companies.collect())) for n in (1, 4)]
    assert rows[0] == rows[1]


def test_companies_and_page(spark, tmp_path):
    r = run(spark)
    got = {x["company_key"]: x for x in r.companies.collect()}
    assert set(got) == {"vela health", "marea", "nube"} and got["vela health"]["n_jobs"] == 1 and got["vela health"]["levels"] == ["JUNIOR"]
    html = report.page(r.companies, "Empresas <hoy>")
    assert "Estudio &lt;Marea&gt;" in html and "best_job_id" not in html
    report.write_tables(r, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "companies")).count() == 3


def test_likely_reposts_of_a_company_and_bucket_are_merged(spark):
    rows = [row(1, "1", "Senior Product Designer", "Nube"), row(2, "2", "Senior Product Desinger", "Nube", ago="hace 1 día"), row(3, "3", "Senior Product Desinger", "Otra"), row(4, "4", "UX Researcher", "Nube"), row(5, "5", "Senior Product Designr", "Nube", location="Barcelona")]
    for n in (1, 3):
        r = pipeline.process(pipeline.postings_of(spark.createDataFrame(rows, RAW).repartition(n), F.lit(TODAY)), F.lit(TODAY))
        got = {x["job_id"]: (x["n_sightings"], x["merged_ids"]) for x in r.postings.collect()}
        assert got == {"2": (2, ["1"]), "3": (1, []), "4": (1, []), "5": (1, [])} and r.reconcile().first()["balanced"]
