"""Registered queries over the at-least-once message log, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazario.common import table
from plazario.operators import delivery


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "deliveries", "seq", "job_id", "merged_ids")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.surplus(_log(spark, sf_dir)).select("seq")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = delivery.identifier_table(_log(spark, sf_dir))
    return delivery.kept_numbers(entries).select(F.col("number").alias("posting_number"), "seq")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, surplus and folded numbers of the log, from one pass over the tables."""
    log = _log(spark, sf_dir)
    numbers = delivery.identifier_table(log).agg(
        F.count_if(F.col("first_seq") != F.lit(2**63 - 1)).alias("n_numbers"),
        F.count_if(F.col("folded") & (F.col("first_seq") != F.lit(2**63 - 1))).alias("n_folded"),
    )
    rows = log.agg(F.count("*").alias("n_rows"), F.count_if(delivery.posting_number("job_id").isNull()).alias("n_without_number"))
    return rows.join(numbers)  # one row each


_DIGITS = "０１２３４５６７８９"
_CLEAN = "regexp_replace(translate({c}, '" + _DIGITS + "', '0123456789'), '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}\\x{{180E}}]', '', 'g')"


def _sql_number(c: str) -> str:
    pattern = "'(^|[^0-9])0*([1-9][0-9]{9})([^0-9]|$)', 2"
    clean = _CLEAN.format(c=c)
    joined = f"regexp_replace(regexp_replace({clean}, '[.,]0+\\s*$', ''), '[\\s._-]+', '', 'g')"
    return f"cast(coalesce(nullif(regexp_extract({clean}, {pattern}), ''), nullif(regexp_extract({joined}, {pattern}), '')) as bigint)"


_SQL = f"""with r as (select seq, {_sql_number('job_id')} as n, merged_ids from deliveries),
named as (select n, {_sql_number('m')} as f from (select n, unnest(merged_ids) as m from r where n is not null)),
folded as (select distinct f from named where f is not null and f <> n),
kept as (select n, min(seq) as seq from r where n is not null and n not in (select f from folded) group by n)
"""


def queries() -> dict:
    return {"p6_found": p6_found, "p6_kept": p6_kept, "p6_counts": p6_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _SQL + "select seq from r where n is not null and seq not in (select seq from kept)",
        "p6_kept": _SQL + "select n as posting_number, seq from kept",
        "p6_counts": _SQL + """select (select count(*) from r) as n_rows, (select count(*) from r where n is null) as n_without_number,
(select count(distinct n) from r) as n_numbers, (select count(distinct n) from r where n in (select f from folded)) as n_folded""",
    }
