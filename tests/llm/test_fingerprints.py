import hashlib
import re

import pytest
from pyspark.sql import functions as F

from repurchase.llm import fingerprints as fp

from .data import prose, table


def shingles(t):
    w = [x for x in re.split(r"[ \t-\r]+", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edits_and_estimates(spark, monkeypatch):
    rows = [(i * 3, prose(30 + 7 * i, i % 40)) for i in range(60)] + [(500, ""), (501, None), (502, "é" * 9)]
    for size in (5, 1000):
        monkeypatch.setattr(fp, "BUCKET_DOCS", size)
        got = {r["doc_id"]: r for r in fp.edit_report(table(spark, rows)).collect()}
        down = sorted(rows, key=lambda x: -x[0])
        off = []
        for (d, t), (_, n) in zip(down, [*down[1:], down[0]], strict=True):
            t, n = t or "", n or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            r = got[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            for other, near in ((edited, r["near_edited"]), (n, r["near_next"])):
                a, b = shingles(t), shingles(other)
                off.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - near))
        assert max(off) < 0.16 and sum(off) / len(off) < 0.03
    same = {}
    for d, t in rows:
        assert same.setdefault(t or "", got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_ties_follow_each_other(spark):
    rows = [(1, "a b c"), (1, "d e f g"), (None, "null id"), (2, "x")]
    got = fp.with_next(table(spark, rows).select("doc_id", "text"), ["text"]).collect()
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)
    by = {r["text"]: r["next_text"] for r in got}
    assert by["null id"] == "x" and by["x"] in ("a b c", "d e f g")


def test_sketches_merge_and_estimate(spark):
    a, b = prose(3000, 1, 3000), prose(3000, 2, 3000)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string")
    s = {c: fp.sketch(F.col(c)) for c in ("a", "b", "both")}
    row = df.select(
        fp.resemblance(fp.merge(s["a"], s["b"]), s["both"]).alias("merged"),
        fp.distinct_count(s["a"]).alias("n"),
        fp.containment(s["a"], s["both"]).alias("inside"),
        fp.containment(s["both"], s["a"]).alias("half"),
    ).first()
    assert row["merged"] > 0.95 and abs(row["n"] / len(shingles(a)) - 1) < 0.3
    assert row["inside"] > 0.7 and 0.35 < row["half"] < 0.65


def test_group_sketch_is_the_merge_of_all_rows(spark):
    rows = [(i, prose(50, i)) for i in range(40)]
    df = table(spark, rows).select(F.lit("g").alias("g"), fp.sketch(F.col("text")).alias("s"))
    got = fp.merge_groups(df, ["g"], "s", salts=4).first()["s"]
    assert got == sorted({h for r in df.collect() for h in r["s"]})[: fp.K]


@pytest.mark.parametrize(
    "kind, ids",
    [
        ("long", [-(2**63), 2**63 - 1, -9 * 10**18, 9 * 10**18, 0, 5, 5, None, None]),
        ("string", ["b", "a", "", "é", "10", "9", None, "a", "zz"]),
        ("long", [*range(40), 2**60, *[7] * 15, *[None] * 12]),
    ],
)
def test_next_document_of_any_ids(spark, monkeypatch, kind, ids):
    """Wide, text, skewed, repeated and null ids, in ranges of three rows."""
    monkeypatch.setattr(fp, "BUCKET_DOCS", 3)
    names = ("_bucket", "_tie", "_up", "_down", "_next")
    df = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], f"doc_id {kind}, text string")
    df = df.selectExpr("*", *(f"'x' as {c}" for c in names))
    order = [r["text"] for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()]
    rows = fp.with_next(df, ["text"])
    assert rows.columns == [*df.columns, "next_text"]
    got = rows.collect()
    assert {r["text"]: r["next_text"] for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))
    assert len(got) == len(ids) and all(r[c] == "x" for r in got for c in names)
