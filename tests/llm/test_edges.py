"""Every operator: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import pytest

from repurchase.llm import decontaminate, fingerprints, fmindex, licenses, lm, mixing, pii, simhash, suffix, toxicity

from .data import EDGES, prose, table

LONG = prose(20_000, 3)


def fit(df):
    spark = df.sparkSession
    return toxicity.fit(df, spark.createDataFrame([(900, 0), (903, 1), (None, 1), (904, None)], "doc_id long, toxic int"))


def benchmark(df):
    return df.sparkSession.createDataFrame([(1, None), (2, ""), (3, "short"), (None, prose(40, 9)), (4, prose(40, 9))], "item_id long, text string")


ROWWISE = {
    "pii": pii.report,
    "simhash": simhash.near_duplicates,
    "licenses": licenses.scan,
    "lm": lm.score_documents,
    "suffix": suffix.remove_repeats,
    "fingerprints": fingerprints.edit_report,
    "fmindex": fmindex.remove_repeats,
    "toxicity": lambda df: toxicity.grade_documents(df, fit(df)),
}
KEEPING = {
    "simhash": simhash.keep_one,
    "toxicity": lambda df: toxicity.keep_clean(df, fit(df)),
    "decontaminate": lambda df: decontaminate.keep_clean(df, benchmark(df)),
    "pii": pii.redact,
}
OTHER = {"mixing": mixing.schedule, "decontaminate": lambda df: decontaminate.matches(df, benchmark(df))}


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


@pytest.mark.parametrize("name", ROWWISE)
def test_one_row_for_each_document(spark, name):
    rows = [*EDGES, (906, LONG)]
    got = ROWWISE[name](table(spark, rows, extra=True)).collect()
    assert ids(got) == sorted((d for d, _ in rows), key=str)


@pytest.mark.parametrize("name", KEEPING)
def test_stages_keep_columns(spark, name):
    df = table(spark, [*EDGES, (906, LONG)], extra=True)
    got = KEEPING[name](df)
    assert got.columns == df.columns
    assert {r["_mark"] for r in got.collect()} == {"x"}


@pytest.mark.parametrize("name", [*ROWWISE, *OTHER])
def test_empty_table(spark, name):
    got = (ROWWISE | OTHER)[name](table(spark, []))
    assert "doc_id" in got.columns and got.collect() == []


@pytest.mark.parametrize("name", KEEPING)
def test_empty_table_keeps_columns(spark, name):
    df = table(spark, [])
    got = KEEPING[name](df)
    assert got.columns == df.columns and got.count() == 0


def test_mixing_and_matches_take_edges(spark):
    df = table(spark, [*EDGES, (907, prose(40, 9)), (907, prose(40, 9))], extra=True)
    read = mixing.schedule(df).where("epoch = 0").collect()
    assert ids(read) == sorted([d for d, _ in EDGES] + [907, 907], key=str)
    hits = decontaminate.matches(df, benchmark(df)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(907, 4), (907, None)}
