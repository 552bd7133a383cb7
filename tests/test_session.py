"""Scratch tables."""

import os

from textloom.session import SHUFFLE_CLEANUP, materialize, release


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_release_deletes_only_what_it_is_given(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 as k")
    a, b = materialize(rows, "a"), materialize(rows.groupBy("k").count(), "b")
    split = materialize(rows, "split", ("k",))
    whole = os.path.dirname(folder(split))
    assert len([x for x in os.listdir(whole) if "=" in x]) == 3
    release(a, split)
    assert not os.path.exists(folder(a)) and not os.path.exists(whole)
    assert sorted(r["count"] for r in b.collect()) == [33, 33, 34]


def test_release_of_an_empty_table(spark):
    empty = materialize(spark.range(0), "empty")
    there = folder(empty)
    release(empty)
    assert not os.path.exists(there)


def test_materialize_restores_the_setting_of_shuffle_files(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    summed = materialize(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "sums")
    assert summed.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP, "false") == before
