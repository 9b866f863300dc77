"""Listings: parameters, order, paging, and results that hold under skew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maillode.operators import browse as b
from maillode.operators import dedup, paging, reports
from maillode.operators.browse import BrowseParams
from maillode.operators.incremental import first_files, replace_children, unseen, upsert

SCHEMA = (
    "maildir_path string, part_path string, sha256 string, filename string,"
    " mime_declared string, sniffed_type string, sniffed_ext string, size long, folder string,"
    " direction string, subject string, from_raw string, to_raw string, decode_failed boolean,"
    " date_parsed string, year string"
)


def occurrence(i, sha, **fields):
    row = {
        "maildir_path": f"/m/cur/{i:04d}",
        "part_path": "2",
        "sha256": sha * 64,
        "filename": f"f{i}.txt",
        "mime_declared": "text/plain",
        "sniffed_type": "text/plain",
        "sniffed_ext": "txt",
        "size": 10,
        "folder": "INBOX",
        "direction": "in",
        "subject": "s",
        "from_raw": "a@b",
        "to_raw": "c@d",
        "decode_failed": False,
        "date_parsed": f"20{i % 20:02d}-01-01T00:00:00+00:00",
    } | fields
    date = row["date_parsed"]
    return tuple(row.values()) + (date[:4] if date else None,)


@pytest.fixture(scope="module")
def skewed(spark):
    """Three hundred occurrences, a third of them one file."""
    rows = [occurrence(i, "a") for i in range(100)]
    rows += [
        occurrence(i, "bcdef"[i % 5], size=i, folder=(".Spam", "INBOX")[i % 2]) for i in range(100, 290)
    ]
    rows += [occurrence(i, "0123456789"[i % 10], date_parsed=None) for i in range(290, 300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def keys(frame):
    return [r.maildir_path for r in frame.orderBy("pos").collect()]


def test_form_values_that_make_no_sense_are_dropped():
    params = BrowseParams.from_form(
        {"direction": "up", "minsize": "big", "sha": "not-a-digest", "page": "-3", "sort": "?"}
    )
    assert (params.direction, params.minsize, params.sha, params.page) == (None, None, None, 0)
    assert BrowseParams.from_form({"page": "x"}).page == 0
    assert BrowseParams.from_form({"page": "2", "collapse": "0"}).collapse is False
    assert BrowseParams.from_form({"sha": "a" * 64}).sha == "a" * 64
    assert params.collapse and not params.noise


def test_noise_is_hidden_unless_asked_for(skewed):
    def count(**form):
        return b.browse(skewed, skewed, BrowseParams(**form)).count()

    everything = skewed.count()
    spam = skewed.filter("folder = '.Spam'").count()
    assert count() == everything - spam
    assert count(noise=True) == everything
    assert count(folder=".Spam") == spam


def test_collapse_takes_the_earliest_and_undated_last(spark):
    rows = [
        occurrence(1, "a", date_parsed=None),
        occurrence(3, "a", date_parsed="2005-01-01T00:00:00+00:00"),
        occurrence(2, "a", date_parsed="2005-01-01T00:00:00+00:00"),
        occurrence(4, "b", date_parsed=None),
    ]
    view = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.maildir_path for r in dedup.collapse(view).collect()) == [
        "/m/cur/0002",
        "/m/cur/0004",
    ]


def test_representative_matches_the_filter_but_copies_count_all(skewed):
    params = BrowseParams(year="2005", sha="a" * 64)
    row = b.listing(skewed, skewed, params).first()
    assert row.copies == 100 and row.date_parsed.startswith("2005")


@pytest.mark.parametrize("sort", ["date", "oldest", "size", "name", "dupes", "unheard-of"])
@pytest.mark.parametrize("collapse", [True, False])
def test_pages_cover_the_listing_once_and_in_order(skewed, sort, collapse):
    params = BrowseParams(noise=True, collapse=collapse, sort=sort)
    got, pages = [], 0
    while True:
        page = b.listing(skewed, skewed, params).orderBy("pos").collect()
        if not page:
            break
        got += page
        pages, params = pages + 1, b.next_page(params)
    totals = b.listing_totals(skewed, skewed, params).first()
    assert (len(got), pages) == (totals.total, totals.pages)
    assert [r.pos for r in got] == list(range(1, len(got) + 1))
    assert len({(r.maildir_path, r.part_path) for r in got}) == len(got)
    dates = [r.date_parsed or "" for r in got]
    if sort in ("date", "unheard-of"):
        assert dates == sorted(dates, reverse=True)
    elif sort == "oldest":
        assert dates == sorted(dates)
    elif sort == "size":
        assert [r.size for r in got] == sorted((r.size for r in got), reverse=True)
    elif sort == "name":
        assert [r.filename for r in got] == sorted(r.filename for r in got)
    else:
        assert [r.copies for r in got] == sorted((r.copies for r in got), reverse=True)


def test_deep_pages_equal_shallow_ones(skewed, monkeypatch):
    params = BrowseParams(noise=True, collapse=False, page=1)
    shallow = b.listing(skewed, skewed, params).collect()
    monkeypatch.setattr(b, "DEEP_ROWS", 10)
    deep = b.listing(skewed, skewed, params).collect()
    assert sorted(shallow) == sorted(deep) and len(deep) == b.PAGE_SIZE


@pytest.mark.parametrize("sort", ["date", "oldest", "size", "name", "dupes"])
@pytest.mark.parametrize("collapse", [True, False])
def test_turning_pages_by_the_last_row_gives_the_listing(spark, sort, collapse):
    """Undated rows, files without a name and equal values on both sides of a page's end."""
    rows = [
        occurrence(
            i, "abcdef"[i * i % 6], size=i % 3, filename=(None, "B", "a", "b")[i % 4],
            date_parsed=None if i % 3 == 0 else f"20{i % 5:02d}-01-01T00:00:00+00:00",
        )
        for i in range(40)
    ]
    view = spark.createDataFrame(rows, SCHEMA)
    params = BrowseParams(collapse=collapse, sort=sort)
    whole = b.listing(view, view, params, size=100).orderBy("pos").collect()
    got, last = [], None
    while True:
        found = b.listing(view, view, params, size=7, after=last).orderBy("pos").collect()
        if not found:
            break
        got += found
        last = found[-1].asDict()
    assert got == whole and len(whole) == (40 if not collapse else view.select("sha256").distinct().count())


def test_the_key_of_the_last_row_reaches_the_scan(skewed, tmp_path):
    skewed.write.parquet(f"{tmp_path}/view")
    stored = skewed.sparkSession.read.parquet(f"{tmp_path}/view")
    keys = b.sort_keys("date")
    last = {"date_parsed": "2004-01-01T00:00:00+00:00", "maildir_path": "/m", "part_path": "2", "pos": 7}
    page = paging.page_after(stored, keys, last, 10)
    mode = skewed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = page._jdf.queryExecution().explainString(mode)
    pushed = next(line for line in plan.split("\n") if line.startswith("PushedFilters"))
    assert "LessThan(date_parsed" in pushed and "LessThan(maildir_path" in pushed


def test_kept_orders_read_the_files_of_a_page(spark, skewed, tmp_path):
    """Forty files of which a page of ten rows touches three at most, wherever it lies."""
    params = BrowseParams(noise=True, collapse=False, sort="oldest")
    path = f"{tmp_path}/order"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 8)
    try:
        b.keep_listing(skewed, skewed, params, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = spark.read.parquet(f"{path}/files")
    assert files.count() >= 38 and files.agg(F.sum("n")).first()[0] == 300
    whole = b.listing(skewed, skewed, params, size=300).orderBy("pos").collect()
    for page in (0, 13, 29):
        keys = paging.page_in_order(spark, path, page * 10, 10)
        assert not any("Sort" in line or "rangepartitioning" in line for line in physical(keys))
        got = b.kept_page(skewed, skewed, path, page, size=10).orderBy("pos").collect()
        assert got == whole[page * 10 : page * 10 + 10]
    rows = files.orderBy("first").collect()
    away = [r.file for r in rows[1:] if r.before >= 140 or r.before + r.n <= 130]
    assert len(away) >= len(rows) - 4  # the first one's footer tells the schema
    for name in away:
        with open("/" + name.removeprefix("file:").lstrip("/"), "r+b") as handle:
            handle.truncate(3)
    got = b.kept_page(skewed, skewed, path, 13, size=10).orderBy("pos").collect()
    assert got == whole[130:140]
    assert b.kept_page(skewed, skewed, path, 30, size=10).count() == 0
    b.keep_listing(skewed, skewed, BrowseParams(noise=True, sort="dupes"), f"{tmp_path}/dupes")
    assert b.kept_page(skewed, skewed, f"{tmp_path}/dupes", 0).first().copies == 100
    b.keep_listing(skewed.limit(0), skewed, params, f"{tmp_path}/empty")
    assert b.kept_page(skewed, skewed, f"{tmp_path}/empty", 0).count() == 0


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_joins_give_the_same_rows_however_hot_keys_are_split(skewed, hot_rows):
    counts = {r.sha256: r.copies for r in dedup.digest_counts(skewed).collect()}
    got = dedup.with_copies(skewed.select("sha256", "maildir_path"), skewed, hot_rows).collect()
    assert len(got) == 300 and all(r.copies == counts[r.sha256] for r in got)
    doubled = dedup.only_duplicated(skewed, skewed, hot_rows)
    assert doubled.count() == sum(n for n in counts.values() if n > 1)
    lookup = dedup.digest_counts(skewed).filter(F.col("sha256") != "b" * 64)
    assert dedup.join_unique(skewed, lookup, "sha256", "inner", hot_rows).count() == 300 - counts["b" * 64]
    assert dedup.join_unique(skewed, lookup, "sha256", "left", hot_rows).count() == 300
    semi = dedup.join_unique(skewed, lookup, "sha256", "left_semi", hot_rows)
    assert semi.columns == skewed.columns and semi.count() == 300 - counts["b" * 64]


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("\n")


def test_plans_stay_narrow(skewed):
    """Files are collapsed on keys and sort columns, and a split join reads its rows once."""
    listed = b.listing(skewed, skewed, BrowseParams(noise=True))
    aggregates = [n for n in physical(listed) if "SortAggregate" in n]
    assert aggregates and not any("from_raw" in n or "subject" in n for n in aggregates)
    every = physical(b.listing(skewed, skewed, BrowseParams(noise=True, collapse=False)))
    assert sum("offset=" in n or "TakeOrderedAndProject" in n for n in every) <= 3
    joined = physical(dedup.with_copies(skewed.select("sha256", "maildir_path"), skewed))
    assert not any("Union" in n for n in joined)


def test_partitioning_does_not_change_results(skewed):
    params = BrowseParams(noise=True)
    wide = b.listing(skewed.repartition(13), skewed.repartition(5), params).collect()
    narrow = b.listing(skewed.coalesce(1), skewed.coalesce(1), params).collect()
    assert sorted(wide) == sorted(narrow)


def test_totals_count_unreferenced_blobs(spark, skewed):
    blobs = skewed.groupBy("sha256").agg(F.max("size").alias("size"))
    spare = spark.createDataFrame([("f" * 63 + "0", 7)], "sha256 string, size long")
    messages = skewed.select("maildir_path").distinct()
    totals = b.facet_totals(skewed, blobs.unionByName(spare), messages).first()
    assert totals.distinct_blobs == blobs.count() + 1
    empty = b.facet_totals(skewed.limit(0), blobs.limit(0), messages.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0)


def test_reports_on_skewed_files(skewed):
    top = reports.wasted_space(skewed.filter("sha256 = repeat('a', 64)")).first()
    assert (top.copies, top.wasted) == (100, 990)
    names = reports.most_repeated(skewed)
    assert names.count() == 100 and names.first().copies == 100
    assert reports.type_share(skewed).first().share == 1.0
    first_names = {r.sha256: r.filename for r in reports.names_by_digest(skewed).collect()}
    assert first_names["a" * 64] == "f0.txt"


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    kids = replace_children(old, new.limit(0), new, "k")
    assert [tuple(r) for r in kids.collect()] == [("a", 1)]
    stored = spark.createDataFrame([("x",)], "sha256 string")
    found = spark.createDataFrame([("x", 1), ("y", 2)], "sha256 string, n int")
    assert [tuple(r) for r in unseen(found, stored).collect()] == [("y", 2)]


@pytest.mark.parametrize("failed", [None, ["/m/cur/0000", "/m/cur/0007", "/m/gone"]])
def test_the_first_files_of_a_run_without_one_task_for_all(spark, skewed, failed):
    """Found as a top-k or in a written order, they are the same; failed ones come last."""
    files = skewed.select("maildir_path", "size", F.lit(1).alias("n"), F.lit("x").alias("file"))
    before = failed and spark.createDataFrame([(path,) for path in failed], "maildir_path string")
    for limit in (1, 120, 299, 300, 1000):
        top = first_files(files, limit, before)
        ranges = first_files(files, limit, before, top_files=0)
        assert ranges.columns == top.columns == files.columns
        assert sorted(ranges.collect()) == sorted(top.collect())
        assert ranges.count() == min(limit, 300)
        paths = {row.maildir_path for row in ranges.collect()}
        assert ("/m/cur/0007" in paths) == (limit >= (300 if failed else 120))
        assert not any("TakeOrdered" in line or "GlobalLimit" in line for line in physical(ranges))
    assert first_files(files, 0, before) is files
    assert first_files(files.limit(0), 5, before, top_files=0).count() == 0
