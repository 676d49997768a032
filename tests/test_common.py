from types import SimpleNamespace

import pytest

from plazario import common
from plazario.operators.pairing import looked_up
from plazario.operators import pairing


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return SimpleNamespace(get=lambda name: None)


def test_a_cluster_session_must_name_the_shared_folder():
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=Context()))
    with pytest.raises(common.NoSharedFolder):
        common.durable(df)


def test_lookup_tells_hot_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(pairing, "HOT", 3)
    left = spark.createDataFrame([(i % 4 if i > 5 else 9, i) for i in range(30)] + [(None, 99), (77, 98)], "k int, v int")
    right = left.where("k is not null and k <> 77").groupBy("k").count().withColumnRenamed("count", "rows").withColumnRenamed("rows", "n")
    got = sorted((r["k"], r["v"], r["n"]) for r in looked_up(left, right, ["k"], "n").collect())
    want = sorted((r["k"], r["v"], r["n"]) for r in left.join(right, "k").collect())
    assert got == want and len(got) == 30


def test_broadcast_only_behind_a_count(spark):
    df = spark.range(10)
    assert "broadcast" in common.broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in common.broadcast_if_small(df, 9)._jdf.queryExecution().analyzed().toString().lower()
