"""Snapshot commit: all tables at once, one winner, readers undisturbed."""

import os
import tempfile
from dataclasses import replace

import pytest

from repurchase.plans.params import FIXTURE
from repurchase.plans.pipeline import open_published, publish
from repurchase.sources import Buckets, ConflictError, Snapshots, ingest_fixture_tables
from repurchase.sources.snapshots import rename_new

from conftest import SMALL


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


@pytest.fixture
def snaps(spark):
    return Snapshots(spark, tempfile.mkdtemp(prefix="snapshots-"))


def values(df):
    return sorted(r.v for r in df.collect())


def test_nothing_is_seen_before_commit_and_versions_stay(spark, snaps):
    assert snaps.open() == {} and snaps.versions() == []
    run = snaps.begin()
    a = run.write("a", numbers(spark, 1, 2))
    run.write("b", numbers(spark, 3))
    assert values(a) == [1, 2] and snaps.open() == {}
    assert run.commit() == 1
    again = snaps.begin()
    again.write("a", numbers(spark, 9))
    assert values(snaps.table("a")) == [1, 2]
    assert again.commit() == 2
    assert values(snaps.table("a")) == [9] and values(snaps.table("b")) == [3]
    assert values(snaps.table("a", 1)) == [1, 2]
    with pytest.raises(KeyError):
        snaps.table("a", 7)


def test_a_frame_opened_before_a_commit_still_reads(spark, snaps):
    for v in (1, 2, 3):
        run = snaps.begin()
        run.write("a", numbers(spark, v))
        run.commit()
        if v == 1:
            early = snaps.table("a")
    assert values(early) == [1] and values(snaps.table("a")) == [3]


def test_of_two_writers_one_wins(spark, snaps):
    one, two = snaps.begin(), snaps.begin()
    one.write("a", numbers(spark, 1))
    two.write("a", numbers(spark, 2))
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    assert values(snaps.table("a")) == [1] and snaps.versions() == [1]


def test_rename_refuses_a_taken_name(spark):
    folder = tempfile.mkdtemp(prefix="rename-")
    for name in ("x", "y"):
        os.mkdir(f"{folder}/{name}")
        open(f"{folder}/{name}/file", "w").write(name)
    assert not rename_new(spark, f"{folder}/x", f"{folder}/y")
    assert open(f"{folder}/y/file").read() == "y" and os.path.exists(f"{folder}/x/file")
    assert rename_new(spark, f"{folder}/x", f"{folder}/z")
    with pytest.raises(Exception):
        rename_new(spark, f"{folder}/absent", f"{folder}/w")


def test_schemas_partitions_and_buckets_come_back(spark, snaps):
    df = spark.range(200).selectExpr("id", "cast(id % 3 as string) p", "timestamp_ntz'2020-01-01 00:00:00' t", "cast(id as decimal(12,2)) d")
    run = snaps.begin()
    run.write("parted", df, ["p"])
    run.write("bucketed", df, buckets=Buckets("id", 4))
    run.commit()
    for name in ("parted", "bucketed"):
        got = Snapshots(spark, snaps.folder).table(name)
        assert got.dtypes == df.dtypes and got.count() == 200
    assert snaps.entries()["bucketed"].buckets["count"] == 4


def test_expire_frees_old_versions_only(spark, snaps):
    for v in (1, 2, 3):
        run = snaps.begin()
        run.write("a", numbers(spark, v))
        if v == 1:
            run.write("b", numbers(spark, 7))
        run.commit()
    pending = snaps.begin()
    pending.write("a", numbers(spark, 4))
    first = snaps.entries(1)["a"].path
    assert snaps.expire(2) == [1] and snaps.versions() == [2, 3]
    assert not os.path.exists(first.removeprefix("file:"))
    assert values(snaps.table("a", 2)) == [2] and values(snaps.table("b")) == [7]
    pending.commit()
    assert values(snaps.table("a")) == [4]
    with pytest.raises(ValueError):
        snaps.expire(0)


def test_a_publish_that_dies_leaves_the_version_before_it(spark, monkeypatch):
    tables = ingest_fixture_tables(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="publish-")
    first = publish(tables, FIXTURE, folder)
    before = first["mature"].count()
    later = replace(FIXTURE, maturity_cutoff="1995-06-01 00:00:00")
    from repurchase.plans.pipeline import Analysis

    monkeypatch.setattr(Analysis, "state_mart_reviews", lambda self, dedupe=False: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        publish(tables, later, folder)
    monkeypatch.undo()
    assert Snapshots(spark, folder).versions() == [1]
    assert open_published(spark, folder)["mature_people"].count() == before
    second = publish(tables, later, folder)
    assert second["mature"].count() < before == first["mature"].count()


def test_the_filled_translation_is_a_stored_table(spark):
    tables = ingest_fixture_tables(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="publish-")
    publish(tables, FIXTURE, folder)
    filled = open_published(spark, folder)["product_category_name_translation"]
    assert filled.inputFiles() and all("/data/" in f for f in filled.inputFiles())
    keys = {r.product_category_name for r in filled.collect()}
    assert {row[0] for row in FIXTURE.backfill_categories} <= keys
