"""Kept counts against counting anew, over runs that add, replace and repeat."""

from __future__ import annotations

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from maillode.operators import browse, counts, dedup
from maillode.plans import views
from maillode.plans.ingest import IngestOptions, ingest
from maillode.plans.store import open_index

from .conftest import BASS, DIRECTOR, HALL, OWNER, PLAN, SCORE, deliver, mail

BINARY = "application/octet-stream"
OCCURRENCE = "sha256 string, year string, folder string, size long"


def rows(frame):
    return sorted(map(str, frame.collect()))


def assert_counts_agree(store):
    attachments, view = store.read("attachments"), views.stored_occurrences(store)
    kept, facets = store.read("digest_counts"), store.read("facet_counts")
    assert rows(dedup.digest_counts(kept)) == rows(dedup.digest_counts(attachments))
    assert counts.kept_years(facets).collect() == browse.facet_years(view).collect()
    assert counts.kept_folders(facets).collect() == browse.facet_folders(view).collect()
    anew = browse.facet_totals(attachments, store.read("blobs"), store.read("messages"))
    assert counts.kept_totals(facets).collect() == anew.collect()
    for params in (
        browse.BrowseParams(),
        browse.BrowseParams(sort="dupes", collapse=False),
        browse.BrowseParams(sort="dupes"),
        browse.BrowseParams(dupes=True, collapse=False),
    ):
        plain = browse.listing(view, attachments, params).collect()
        assert plain and browse.listing(view, kept, params).collect() == plain


def change(mailbox, number):
    deliver(mailbox, "1205.in", mail(f"Corrected {number}", BASS, DIRECTOR, ((BINARY, b"n%d" % number, "b2"),)), "cur")
    os.utime(mailbox / "cur" / "1205.in", (number, number))


def test_counts_follow_the_runs(spark, mailbox, tmp_path):
    out, mine = str(tmp_path / "index"), IngestOptions(me=OWNER)
    ingest(spark, str(mailbox), out, mine)
    store = open_index(spark, out)
    assert_counts_agree(store)
    ingest(spark, str(mailbox), out, mine)  # nothing new
    assert_counts_agree(store)
    change(mailbox, 1)
    deliver(mailbox / ".Drafts", "d", mail("Draft", DIRECTOR, HALL, ((BINARY, SCORE, "s"), (BINARY, PLAN, "p"))))
    ingest(spark, str(mailbox), out, mine)
    assert_counts_agree(store)
    before = store.read("digest_counts").count()
    ingest(spark, str(mailbox), out, replace(mine, reparse=True))  # all again, all as before
    assert store.read("digest_counts").count() == before
    assert_counts_agree(store)


def test_an_index_begun_without_counts_gets_them(spark, mailbox, tmp_path):
    out = str(tmp_path / "index")
    ingest(spark, str(mailbox), out, IngestOptions(me=OWNER))
    store = open_index(spark, out)
    version, tables = store.manifest()
    old = {name: found for name, found in tables.items() if name not in ("digest_counts", "facet_counts")}
    store.commit(old, version + 1)
    change(mailbox, 2)
    ingest(spark, str(mailbox), out, IngestOptions(me=OWNER))
    assert_counts_agree(store)


def test_what_goes_entirely_leaves_no_row(spark):
    first = spark.createDataFrame([("a", "1999", "x", 5), ("a", None, "y", 5), ("b", "1999", "x", 0)], OCCURRENCE)
    none = first.filter(F.lit(False))
    came = counts.digest_differences(first, none).unionAll(counts.digest_differences(none, first.filter("sha256 = 'b'")))
    assert dedup.digest_counts(came).collect() == [("a", 2)]
    facets = counts.facet_differences(first, none, first, none, first).unionAll(
        counts.facet_differences(none, first, none, first, none)
    )
    assert counts.facet_counts(facets).collect() == [("files", None, 3, 10)]
    assert counts.kept_totals(facets).first()["distinct_blobs"] == 3
    assert counts.kept_years(facets).collect() == counts.kept_folders(facets).collect() == []
    assert counts.digest_differences(first, first).collect() == []


@pytest.mark.parametrize("what", ["copies", "totals"])
def test_of_no_runs(spark, what):
    if what == "copies":
        assert dedup.digest_counts(spark.createDataFrame([], counts.DIGESTS)).collect() == []
    else:
        totals = counts.kept_totals(spark.createDataFrame([], counts.FACETS)).first()
        assert set(totals.asDict().values()) == {0}


def test_a_page_reads_no_occurrences_for_its_copies(spark, mailbox, tmp_path):
    """With kept differences, nothing but them is summed for the copies of a page."""
    out = str(tmp_path / "index")
    ingest(spark, str(mailbox), out, IngestOptions(me=OWNER))
    store = open_index(spark, out)
    page = browse.listing(views.stored_occurrences(store), store.read("digest_counts"), browse.BrowseParams())
    assert not [f for f in page.inputFiles() if "/attachments/" in f]
    assert [f for f in page.inputFiles() if "/digest_counts/" in f]
