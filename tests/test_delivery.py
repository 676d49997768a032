import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plazario.operators import delivery as D

SCHEMA = "seq bigint, job_id string, merged_ids array<string>, number string"


@given(st.lists(st.integers(0, 10**10 - 1), max_size=200))
@settings(max_examples=50, deadline=None)
def test_permutation_is_a_bijection(ids):
    x = np.array(ids, np.uint64)
    assert (D.restore(D.permute(x)) == x).all()
    assert len(set(D.permute(x).tolist())) == len(set(ids))


def test_wide_identifiers_are_refused():
    with pytest.raises(ValueError):
        D.permute(np.array([1 << D.ID_BITS], np.uint64))


def test_table_keeps_the_first_and_finds_exactly():
    t = D.QuotientTable()
    for ids, seqs in (([5, 7, 5], [9, 3, 4]), ([7, 8], [1, 2])):
        t.insert(D.permute(np.array(ids)), np.array(seqs), np.zeros(len(ids), bool))
    at = t.find(np.array([5, 7, 8, 6]))
    assert [int(t.seqs[i]) if i >= 0 else None for i in at] == [4, 1, 2, None]
    assert len(t) == 3 and t.starts[-1] == 3


@pytest.mark.parametrize(
    "text,number",
    [
        ("4000000001", 4000000001), (" 4000000001\n", 4000000001), ("004000000001", 4000000001), ("400 000 0001", 4000000001), ("4000000001.0", 4000000001), ("https://x.example/view/4000000001?ref=feed", 4000000001),
        ("urn:oferta:4000000001", 4000000001), ("４００００００００１", 4000000001), ("4000​000001", 4000000001), ("400-000-0001", 4000000001), ("", None), (" ", None), (None, None), ("12345", None), ("40000000011", None),
    ],
)
def test_posting_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(D.posting_number("t").alias("n")).first()["n"] == number


def brute(rows):
    kept, folded = {}, set()
    for _, job, merged, _ in rows:
        if job:
            folded |= {m for m in merged or [] if m and m != job}
    for seq, job, _, _ in rows:
        if job and job not in folded:
            kept[job] = min(kept.get(job, seq), seq)
    return {seq for seq, job, _, _ in rows if job and kept.get(job) != seq}


def test_surplus_against_brute_force(spark):
    rng = np.random.default_rng(1)
    ids = [str(4000000000 + i) for i in range(40)]
    # a third of all rows carries one number
    rows = [(i, ids[0] if i % 3 == 0 else ids[rng.integers(40)] if rng.random() > 0.05 else "", [ids[rng.integers(40)]] if rng.random() < 0.1 else None if i % 7 else [], "x") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = D.surplus(df)
    assert got.columns == df.columns
    assert {r["seq"] for r in got.collect()} == brute(rows)
    kept = {r["seq"] for r in D.one_copy(df).collect()}
    assert kept == {s for s, j, _, _ in rows if j} - brute(rows)


def test_batches_inserted_into_history(spark, tmp_path):
    first = [(1, "4000000001", [], "a"), (2, "4000000002", ["4000000003"], "a")]
    second = [(3, "4000000001", [], "a"), (4, "4000000003", None, "a"), (5, "4000000004", ["4000000004"], "a")]
    D.identifier_table(spark.createDataFrame(first, SCHEMA)).write.parquet(str(tmp_path / "t"))
    batch = spark.createDataFrame(second, SCHEMA)
    table = D.identifier_table(batch, spark.read.parquet(str(tmp_path / "t")))
    assert {r["seq"] for r in D.surplus(batch, table).collect()} == {3, 4}


def test_empty(spark):
    assert D.surplus(spark.createDataFrame([], SCHEMA)).where(F.col("seq") > 0).count() == 0
