"""The trigram index against the plain filter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maillode.operators import search as s
from maillode.operators.browse import BrowseParams, browse

from .test_browse import SCHEMA, occurrence

WORDS = ["Harvest", "lantern", "ÄPFEL", "o'clock", "ab", "", None, "100% sure", "under_score"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("search")
    rows = [occurrence(i, "a", subject=WORDS[i % 9], from_raw=f"Sender {i // 9}") for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartitionByRange(9, "subject").write.parquet(f"{base}/occurrences")
    stored = spark.read.schema(frame.schema).parquet(f"{base}/occurrences")
    s.update_bitmaps(stored, f"{base}/bitmaps")
    return base, stored, spark.read.parquet(f"{base}/bitmaps")


QUERIES = ["harvest", "HARVEST", "ntern", "Äpf", "äpf", "o'c", "ab", "a", "", "100%", "e%sur", "er_s",
           "sender 7", "nothing like it", "%", "__", "ender 1"]


@pytest.mark.parametrize("q", QUERIES)
def test_same_rows_as_the_filter(table, q):
    _, stored, bitmaps = table
    for params in (BrowseParams(q=q, noise=True), BrowseParams(q=q, noise=True, year="2003")):
        plain = sorted(map(str, browse(stored, stored, params).collect()))
        assert sorted(map(str, s.search(stored, stored, bitmaps, params).collect())) == plain


def test_trigrams_of_patterns():
    assert s.trigrams_of("abcd") == ["abc", "bcd"]
    assert s.trigrams_of("ab_cd%efg") == ["efg"]
    assert s.trigrams_of("ab%c") == s.trigrams_of("") == []


def test_files_without_the_trigrams_are_not_opened(spark, table, tmp_path):
    _, stored, _ = table
    stored.write.parquet(f"{tmp_path}/copy")
    copy = spark.read.schema(stored.schema).parquet(f"{tmp_path}/copy")
    s.update_bitmaps(copy, f"{tmp_path}/bitmaps")
    bitmaps = spark.read.parquet(f"{tmp_path}/bitmaps")
    names = {row["file"] for row in bitmaps.collect()}
    holding = {row["file"] for row in s.files_with(bitmaps, "lantern").collect()}
    assert 0 < len(holding) < len(names)
    for name in names - holding:  # not even their footers can be read any more
        with open("/" + name.removeprefix("file:").lstrip("/"), "r+b") as handle:
            handle.truncate(3)
    found = s.search(copy, copy, bitmaps, BrowseParams(q="lantern", noise=True))
    assert found.count() == 10


def test_only_new_files_are_added(spark, table, tmp_path):
    _, stored, _ = table
    stored.limit(5).write.parquet(f"{tmp_path}/o")
    read = lambda: spark.read.schema(stored.schema).parquet(f"{tmp_path}/o")
    for times in (1, 2):
        s.update_bitmaps(read(), f"{tmp_path}/b")
    stored.limit(7).write.mode("append").parquet(f"{tmp_path}/o")
    s.update_bitmaps(read(), f"{tmp_path}/b")
    files = [row["file"] for row in spark.read.parquet(f"{tmp_path}/b").collect()]
    assert len(files) == len(set(files)) == len(read().inputFiles())


def test_bitmaps_have_one_size(table):
    _, _, bitmaps = table
    sizes = bitmaps.select(F.octet_length("bitmap").alias("n")).distinct().collect()
    assert [row["n"] for row in sizes] == [s.SLOTS // 8]


def test_long_texts_in_one_pass(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [occurrence(1, "a", subject=long + " needle"), occurrence(2, "b", subject="short")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/o")
    stored = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/o")
    s.update_bitmaps(stored, f"{tmp_path}/b")
    found = s.search(stored, stored, spark.read.parquet(f"{tmp_path}/b"), BrowseParams(q="59999 need", noise=True))
    assert found.count() == 1


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_task_sorts_texts_or_all_their_trigrams(table, tmp_path):
    base, stored, _ = table
    for path in (f"{tmp_path}/none", f"{base}/bitmaps"):
        plan = _plan(s.trigram_bitmaps(s.new_rows(stored, path)))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # Printed from the result down: what explodes the trigrams lies below a hash aggregate.
        below = plan[plan.rindex("Sort ["):]
        assert "HashAggregate(keys=[file" in below[: below.index("Generate")]


def test_bitmaps_hold_each_trigram_once_or_often(spark):
    rows = [("f", "abcabcabc", "abcd", None, ""), ("f", "ABC", None, None, "xabc"), ("g", "ab", "Zzz", "", "zzz")]
    frame = spark.createDataFrame(rows, "file string, filename string, subject string, from_raw string, to_raw string")
    grams = [("f", g) for g in ("abc", "bca", "cab", "bcd", "xab")] + [("g", "zzz")]
    slots = spark.createDataFrame(grams, "file string, gram string").select("file", s._slot(F.col("gram")).alias("slot"))
    expected = slots.groupBy("file").agg(F.bitmap_construct_agg("slot").alias("bitmap"))
    assert sorted(s.trigram_bitmaps(frame).collect()) == sorted(expected.collect())
