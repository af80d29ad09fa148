import collections
import math

import pytest

from repurchase.llm import mixing


def docs(spark):
    rows = []
    for s, n in (("a", 900), ("b", 60), ("c", 9), (None, 30)):
        rows += [(i, " ".join(["w"] * (1 + i % 11)), s) for i in range(len(rows), len(rows) + n)]
    rows += [(5000, "", "a"), (5001, None, "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repeat_limit_and_budgets(spark):
    df = docs(spark)
    weights = {r["source"]: r for r in mixing.source_weights(mixing.token_rows(df), repeat_limit=4.0).collect()}
    assert sum(r["weight"] for r in weights.values()) == pytest.approx(1)
    assert max(r["passes"] for r in weights.values()) == pytest.approx(4, abs=1e-4) and weights["a"]["passes"] == 1
    got = mixing.schedule(df, repeat_limit=4.0, block_docs=50).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in df.collect()}
    read = collections.Counter()
    for r in got:
        read[r["source"]] += r["n_tokens"]
    total = sum(read.values())
    for s, r in weights.items():
        assert read[s] / total == pytest.approx(r["weight"], abs=0.01)
        assert read[s] == pytest.approx(r["passes"] * r["n_tokens"], abs=6 * r["n_blocks"])
    copies = collections.Counter((r["doc_id"], r["epoch"]) for r in got)
    assert set(copies.values()) == {1}
    assert all(0 <= r["slot"] < 1 for r in got)


def test_entropy_target(spark):
    rows = mixing.source_weights(mixing.token_rows(docs(spark)), entropy=1.0).collect()
    h = -sum(r["weight"] * math.log(r["weight"]) for r in rows if r["weight"])
    assert h == pytest.approx(1.0, abs=1e-4)


def test_schedule_is_the_same_every_time(spark):
    df = docs(spark)
    a, b = (sorted(map(str, mixing.schedule(x).collect())) for x in (df, df.repartition(7)))
    assert a == b


def test_rows_of_one_id_spread_over_blocks(spark):
    rows = [(None, f"text {i}", "a") for i in range(3000)] + [(7, "the same row", "a")] * 9000 + [(8, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(df, block_docs=500).where("epoch = 0").toPandas()
    assert len(got) == len(rows)
    per = got[got["source"] == "a"].groupby("block").size()
    assert len(per) == 24 and per.max() < 700
    again = mixing.schedule(df.repartition(5), block_docs=500).where("epoch = 0").toPandas()
    same = lambda t: sorted(map(tuple, t.fillna(-1).values.tolist()))
    assert same(got) == same(again)
