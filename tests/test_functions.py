import datetime
import unicodedata

import pytest

from plazario.functions import dates, posting, text, urls

TODAY = datetime.date(2026, 9, 4)


def value(spark, expr, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(expr("x").alias("y")).first()["y"]


def nfkd(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@pytest.mark.parametrize("x", ["Diseñador Gráﬁco", "ｕｘ ½", "ño", "Ünïcödé", "Ⅱ", "Москва", "", None])
def test_strip_accents(spark, x):
    got = value(spark, text.strip_accents, x)
    assert got == (None if x is None else nfkd(x).replace("⁄", "⁄"))


@pytest.mark.parametrize("x,y", [("Ánfora & Co.", "anfora and co"), ("  ", ""), ("A--B", "a b"), (None, None)])
def test_basic_norm(spark, x, y):
    assert value(spark, text.basic_norm, x) == y


@pytest.mark.parametrize("x,y", [("Vela Health, S.L.U.", "vela health"), ("Grupo SL", "grupo sl"), ("Nube Holding Spain SA", "nube"), ("SA", "sa")])
def test_company_norm(spark, x, y):
    assert value(spark, text.company_norm, x) == y


@pytest.mark.parametrize("x,y", [("Diseñador/a UX (H/M) - Remoto", "disenador ux"), ("Senior Product Designer (m/f/d)", "senior product designer")])
def test_title(spark, x, y):
    assert value(spark, text.normalize_title, x) == y


def test_title_core(spark):
    assert value(spark, text.title_core, "Junior UX Designer") == value(spark, text.title_core, "Designer UX (híbrido)") == "designer ux"


@pytest.mark.parametrize("x,y", [("Estudio Marea", "EM"), ("nube", "NU"), ("· ·", "?"), (None, "?")])
def test_monogram(spark, x, y):
    assert value(spark, text.monogram, x) == y


@pytest.mark.parametrize(
    "x,days,sure",
    [("hace 3 días", 3, 1.0), ("hace 2 semanas", 18, 0.6), ("1 month ago", 45, 0.3), ("hace 3 meses", 105, 0.3), ("5 hours ago", 0, 1.0), ("just now", 0, 1.0), ("???", None, 0.5), ("", None, 0.5), (None, None, 0.5)],
)
def test_relative_dates(spark, x, days, sure):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x, None), (x, "2026-09-01"), (x, "2026-9-1")], "x string, iso string").withColumn("t", text.folded("x"))
    date, confidence = dates.posted("t", "iso", F.lit(TODAY))
    rows = df.select(date.alias("d"), confidence.alias("c")).collect()
    assert (rows[0]["d"], rows[0]["c"]) == (None if days is None else TODAY - datetime.timedelta(days), sure)
    assert (rows[1]["d"], rows[1]["c"]) == (datetime.date(2026, 9, 1), 1.0)
    assert rows[2]["c"] == sure


@pytest.mark.parametrize("x,y", [("https://x/company/abc/?a=1", "abc"), ("https://x/company/abc", "abc"), ("https://x/", None), (None, None)])
def test_slug(spark, x, y):
    assert value(spark, urls.company_slug, x) == y


@pytest.mark.parametrize("x,y", [("Abc-1/", "abc-1"), ("-abc", None), ("", None), (None, None)])
def test_valid_slug(spark, x, y):
    assert value(spark, urls.valid_slug, x) == y


@pytest.mark.parametrize(
    "url,code,final,verdict",
    [("u/company/a", None, None, "sin respuesta"), ("u/company/a", 429, None, "bloqueado"), ("u/company/a", 404, None, "muerto"), ("u/company/a", 200, "u/login", "bloqueado"), ("u/company/a", 200, "u/x", "redirigido"), ("u/company/a", 200, "u/company/a/", "ok"), ("u/j", 200, None, "ok")],
)
def test_verdict(spark, url, code, final, verdict):
    df = spark.createDataFrame([(url, code, final)], "u string, c int, f string")
    assert df.select(urls.link_verdict("u", "c", "f").alias("v")).first()["v"] == verdict


@pytest.mark.parametrize("place,mode,bucket", [("Madrid, España (Remoto)", None, "MADRID"), ("Remoto, España", None, "REMOTE_ES"), ("", "remote", "REMOTE_ES"), ("Vigo", None, "REST_ES"), ("Lisboa", "remote", "OUTSIDE_ES"), (None, None, "UNKNOWN")])
def test_bucket(spark, place, mode, bucket):
    df = spark.createDataFrame([(place, mode)], "p string, m string")
    assert df.select(posting.location_bucket("p", "m").alias("b")).first()["b"] == bucket
