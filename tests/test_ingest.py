"""End to end over the choir's mailbox: scan, ingest, re-run, change, stream."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from maillode.errors import MaillodeError
from maillode.operators import browse
from maillode.plans import ingest as plan
from maillode.plans import views
from maillode.plans.ingest import IngestOptions, ingest, ingest_files, rederive
from maillode.plans.store import open_index
from maillode.sources import maildir as source
from maillode.streaming.ingest import stream_ingest

from .conftest import BASS, DIRECTOR, HALL, NOTE, OWNER, PLAN, SCORE, SOUND, build_mailbox, deliver, mail

MINE = IngestOptions(me=OWNER)
BINARY = "application/octet-stream"


def run(spark, root, out, **options):
    return ingest(spark, str(root), str(out), IngestOptions(me=OWNER, **options)).first()


def names(frame):
    return sorted(os.path.basename(row["maildir_path"]) for row in frame.collect())


def test_scan(spark, mailbox):
    found = {os.path.basename(r.maildir_path): r.folder for r in source.scan_maildir(spark, str(mailbox)).collect()}
    assert found == {
        "1204.in": "INBOX", "1205.in": "INBOX", "x1": ".Outbox",
        "t1": "Tours.1998", "t2": "Tours.1998",
    }


def test_scan_of_odd_trees(spark, tmp_path):
    root = tmp_path / "odd"
    deliver(root / "one" / "two" / "three", "deep", b"x")
    deliver(root / "new" / "inner", "below", b"x", "cur")
    (root / "new" / "inner" / "loose").write_bytes(b"x")
    deliver(root / "tmp", "never", b"x")
    deliver(root, "_underscore", b"x")
    os.symlink(root / "one", root / "again")
    assert names(source.scan_maildir(spark, str(root))) == ["_underscore", "below", "deep"]


def test_missing_directory_and_missing_index(spark, tmp_path):
    with pytest.raises(MaillodeError, match="no such mail directory"):
        source.scan_maildir(spark, str(tmp_path / "nowhere"))
    with pytest.raises(MaillodeError, match="no index"):
        open_index(spark, str(tmp_path / "nowhere"))


def test_unreadable_files_are_rows(spark, mailbox):
    os.symlink(mailbox / "lost", mailbox / "cur" / "broken-link")
    with open(os.fsencode(mailbox) + b"/new/latin-\xe9", "wb") as handle:
        handle.write(b"x")
    scanned = source.scan_maildir(spark, str(mailbox))
    assert source.with_file_stats(scanned).filter("read_error IS NOT NULL").count() == 2
    assert source.with_file_bytes(scanned).filter("raw IS NULL").count() == 2


def test_unlisted_directories_are_rows(spark, tmp_path):
    """A directory that goes while it is walked is reported, and so fails the run's count."""
    errors: list = []
    assert list(source.message_directories(str(tmp_path / "gone"), errors)) == []
    assert len(errors) == 1 and errors[0][1].startswith("listing failed")
    inside = list(source.message_files(str(tmp_path / "gone" / "cur")))
    assert inside[0][0].endswith("cur") and inside[0][1].startswith("listing failed")
    files = spark.createDataFrame(
        [(str(tmp_path), "INBOX", "listing failed: x")],
        "maildir_path string, folder string, scan_error string",
    )
    stats = ingest_files(files, str(tmp_path / "o"), MINE).first()
    assert (stats.scanned, stats.indexed, stats.errors) == (1, 0, 1)
    failure = open_index(spark, str(tmp_path / "o")).read("failures").first()
    assert failure.problem == "listing failed: x"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """An index to read; tests that change one make their own."""
    base = tmp_path_factory.mktemp("indexed")
    box = build_mailbox(base / "choir")
    return box, base / "index", run(spark, box, base / "index")


def test_first_run(spark, index):
    _, out, stats = index
    assert (stats.scanned, stats.indexed, stats.skipped, stats.errors) == (5, 5, 0, 0)
    assert (stats.attachments, stats.new_blobs, stats.dup_blobs) == (6, 4, 2)
    store = open_index(spark, str(out))
    directions = {r.subject: r.direction for r in store.read("messages").collect()}
    assert directions == {"Hall": "in", "Bass part": "in", "Booking": "out", "Where": "out", "Echo": "in"}
    assert "..\\..\\autoexec" in {r.filename for r in store.read("attachments").collect()}
    contents = store.read("blob_content")
    assert {bytes(r.content) for r in contents.collect()} == {SCORE, SOUND, PLAN, NOTE}
    assert contents.filter(F.sha2("content", 256) != F.col("sha256")).count() == 0
    kinds = {r.sniffed_ext for r in store.read("blobs").collect()}
    assert kinds == {"zip", "wav", "sqlite", "txt"}


def assert_views_agree(store):
    joined = views.joined_occurrences(store)
    stored = views.stored_occurrences(store).select(*joined.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, joined.collect()))


def test_runs_after_the_first(spark, mailbox, tmp_path):
    out = tmp_path / "index"
    run(spark, mailbox, out)
    again = run(spark, mailbox, out)
    assert (again.scanned, again.skipped, again.indexed, again.attachments) == (5, 5, 0, 0)
    anew = run(spark, mailbox, out, reparse=True)
    assert (anew.indexed, anew.new_blobs, anew.dup_blobs) == (5, 0, 6)
    store = open_index(spark, str(out))
    counts = [store.read(t).count() for t in ("messages", "attachments", "blobs", "blob_content", "bodies", "runs")]
    assert counts == [5, 6, 4, 4, 5, 3]

    # One message is written over, one comes, one goes.
    deliver(mailbox, "1205.in", mail("Bass part, corrected", BASS, DIRECTOR, ((BINARY, b"new notes", "b2"),)), "cur")
    deliver(mailbox / ".Drafts", "d", mail("Draft", DIRECTOR, HALL))
    os.remove(mailbox / "Tours.1998" / "new" / "t1")
    stats = run(spark, mailbox, out)
    assert (stats.scanned, stats.indexed, stats.skipped, stats.new_blobs) == (5, 2, 3, 1)
    subjects = {r.subject for r in store.read("messages").collect()}
    # What is gone from disk stays in the index.
    assert subjects == {"Hall", "Bass part, corrected", "Booking", "Where", "Echo", "Draft"}
    assert {r.filename for r in store.read("attachments").collect()} == {
        "echo.wav", "seats.db", "b2", "for you", "note.txt", "..\\..\\autoexec"
    }
    assert store.read("blobs").count() == 5
    assert_views_agree(store)


def test_a_change_leaves_other_buckets_alone(spark, tmp_path):
    box = tmp_path / "box"
    for n in range(40):
        deliver(box, f"m{n}", mail(f"Mail {n}", BASS, DIRECTOR))
    run(spark, box, tmp_path / "o")
    store = open_index(spark, str(tmp_path / "o"))
    files_of = lambda: set(store.read("messages").inputFiles())
    before = files_of()
    deliver(box, "m7", mail("Changed", BASS, DIRECTOR))
    run(spark, box, tmp_path / "o")
    subjects = sorted(r.subject for r in store.read("messages").collect())
    assert subjects == sorted(["Changed", *(f"Mail {n}" for n in range(40) if n != 7)])
    written = [f for f in files_of() - before]
    assert len(before - files_of()) <= 1 or len(written) <= 2
    assert store.read("bodies").count() == 40


def renamed_at(monkeypatch, number, rename):
    """Call ``rename`` before contents are read for the given time."""
    read, calls = plan.blob_contents, []

    def reading(*args):
        calls.append(1)
        if len(calls) == number:
            rename()
        return read(*args)

    monkeypatch.setattr(plan, "blob_contents", reading)


def test_content_of_a_renamed_message_comes_from_another(spark, mailbox, tmp_path, monkeypatch):
    """The first holder of the score is flagged, and so renamed, while a run is under way."""
    path = mailbox / ".Outbox" / "cur" / "x1"
    renamed_at(monkeypatch, 1, lambda: path.rename(path.with_name("x1:2,S")))
    stats = run(spark, mailbox, tmp_path / "o")
    assert (stats.new_blobs, stats.errors) == (4, 0)
    store = open_index(spark, str(tmp_path / "o"))
    found = {bytes(r.content) for r in store.read("blob_content").filter("content IS NOT NULL").collect()}
    assert found == {SCORE, SOUND, PLAN, NOTE}


def test_holders_are_tried_in_growing_rounds(spark, tmp_path):
    """A third of all messages hold one digest, and a single one of them can still be read."""
    holders = spark.range(100_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'd' || id END AS sha256",
        "'/m/cur/' || id AS maildir_path", "'2' AS part_path", "5L AS size",
    )
    found = plan.next_holders(holders, holders.limit(0), 8)
    steps = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in steps and "partial_min" in steps
    one, tried, most, rounds = "/m/cur/77778", holders.limit(0), 1, 0
    hot = holders.filter("sha256 = 'hot'").cache()
    while True:
        rounds += 1
        step = plan.next_holders(hot, tried, most)
        step.write.parquet(f"{tmp_path}/round={rounds}")
        step = spark.read.parquet(f"{tmp_path}/round={rounds}")
        assert 0 < step.count() <= most and step.join(tried, plan.HOLDER, "left_semi").isEmpty()
        if step.filter(F.col("maildir_path") == one).count():
            break
        tried, most = spark.read.parquet(str(tmp_path)).drop("round"), most * plan.MORE_TRIES
    assert rounds <= 8
    hot.unpersist()
    few = plan.next_holders(hot.limit(5), hot.limit(0), 10_000)
    assert few.count() == 5 and few.columns == [*plan.HOLDER, "size"]


def test_content_comes_from_the_last_holder_there_is(spark, tmp_path, monkeypatch):
    box = tmp_path / "box"
    for n in range(40):
        deliver(box, f"m{n:02}", mail(f"Mail {n}", BASS, DIRECTOR, ((BINARY, SCORE, "s"),)))
    read = plan.blob_contents

    def only_one(blobs, raws=None):
        return read(blobs.filter("maildir_path LIKE '%m33'"), raws)

    monkeypatch.setattr(plan, "blob_contents", only_one)
    stats = run(spark, box, tmp_path / "o")
    assert (stats.indexed, stats.new_blobs, stats.errors) == (40, 1, 0)
    contents = open_index(spark, str(tmp_path / "o")).read("blob_content")
    assert [bytes(r.content) for r in contents.collect()] == [SCORE]


def test_lost_content_is_reported_and_taken_in_later(spark, mailbox, tmp_path, monkeypatch):
    path = mailbox / "Tours.1998" / "new" / "t1"
    renamed_at(monkeypatch, 1, lambda: path.rename(path.with_name("t1:2,S")))
    first = run(spark, mailbox, tmp_path / "o")
    assert (first.indexed, first.new_blobs, first.errors) == (4, 3, 1)
    store = open_index(spark, str(tmp_path / "o"))
    assert names(store.read("failures")) == ["t1"]
    digests = {r.sha256 for r in store.read("blobs").collect()}
    kept = store.read("blob_content").filter("content IS NOT NULL")
    assert digests == {r.sha256 for r in kept.collect()} and len(digests) == 3
    assert "Where" not in {r.subject for r in store.read("messages").collect()}
    second = run(spark, mailbox, tmp_path / "o")
    assert (second.indexed, second.new_blobs, second.errors) == (1, 1, 0)
    kept = store.read("blob_content").filter("content IS NOT NULL")
    assert {bytes(r.content) for r in kept.collect()} == {SCORE, SOUND, PLAN, NOTE}


def test_limit_and_minimum_size(spark, mailbox, tmp_path):
    indexed = [run(spark, mailbox, tmp_path / "a", limit=2).indexed for _ in range(4)]
    assert indexed == [2, 2, 1, 0]
    large = run(spark, mailbox, tmp_path / "b", min_size=len(SOUND))
    sizes = {r.size for r in open_index(spark, str(tmp_path / "b")).read("blobs").collect()}
    assert large.attachments == 3 and sizes == {len(SOUND), len(PLAN)}


def test_messages_that_fail(spark, mailbox, tmp_path):
    """They are tried again, but after all others when a run is limited."""
    deliver(mailbox / ".A", "0-broken", b'To: "\n\n.')
    first = run(spark, mailbox, tmp_path / "o")
    again = run(spark, mailbox, tmp_path / "o")
    assert (first.indexed, first.errors) == (5, 1) and (again.skipped, again.errors) == (5, 1)
    assert names(open_index(spark, str(tmp_path / "o")).read("failures")) == ["0-broken"] * 2
    deliver(mailbox, "9-later", mail("Later", BASS, DIRECTOR))
    limited = run(spark, mailbox, tmp_path / "o", limit=1)
    assert (limited.indexed, limited.errors) == (1, 0)
    # The first run of an index doesn't know yet; it reads on until it has enough.
    fresh = run(spark, mailbox, tmp_path / "p", limit=3)
    assert (fresh.indexed, fresh.errors) == (3, 1)


def test_directions_for_another_owner(spark, mailbox, tmp_path):
    ingest(spark, str(mailbox), str(tmp_path / "o"), IngestOptions())
    store = open_index(spark, str(tmp_path / "o"))
    found = {r.subject: r.direction for r in store.read("messages").collect()}
    assert found["Booking"] == "out" and found["Where"] == "in"
    rederive(spark, str(tmp_path / "o"), ["bass@singers.test"])
    for table in ("messages", "occurrences"):
        rows = {r.subject: r.direction for r in store.read(table).collect()}
        assert rows["Echo"] == "out" and rows["Where"] == "in"
    assert store.read("occurrences").count() == 6


def test_browsing_a_stored_index(spark, index):
    _, out, _ = index
    store = open_index(spark, str(out))
    assert_views_agree(store)
    view, attachments = views.stored_occurrences(store), store.read("attachments")
    listed = browse.listing(view, attachments, browse.BrowseParams()).collect()
    copies = {r.sniffed_ext: r.copies for r in listed}
    assert copies == {"zip": 2, "wav": 2, "sqlite": 1, "txt": 1}
    score = next(r for r in listed if r.sniffed_ext == "zip")
    every = browse.listing(view, attachments, browse.BrowseParams.copies_of(score.sha256))
    assert sorted(r.filename for r in every.collect()) == ["b.zip", "for you"]
    totals = browse.facet_totals(attachments, store.read("blobs"), store.read("messages")).first()
    assert (totals.occurrences, totals.distinct_blobs, totals.messages) == (6, 4, 5)
    assert totals.saved_bytes == len(SCORE) + len(SOUND)


def test_one_message(spark, index):
    _, out, _ = index
    store = open_index(spark, str(out))
    attachments = store.read("attachments")
    opened = attachments.filter("filename = 'seats.db'")
    head = views.message_heads(opened, store.read("messages"), store.read("bodies"), 8).first()
    assert (head.subject, head.body, head.truncated) == ("Hall", "Dear all", True)
    parts = views.message_parts(opened, attachments, store.read("blobs")).collect()
    assert [(p.part_path, p.size) for p in parts] == [("2", len(SOUND)), ("3", len(PLAN))]


def test_files_by_digest(spark, index):
    _, out, _ = index
    found = {r.download_name: r for r in views.stored_files(open_index(spark, str(out)), 9).collect()}
    assert set(found) == {"b.zip", "echo.wav", "seats.db", "note.txt"} or "for you" in found
    note = found["note.txt"]
    assert (note.text, note.charset, note.truncated) == ("Rehearsal", "utf-8", True)
    assert found["seats.db"].text is None


def test_sql_over_a_stored_index(spark, index):
    _, out, _ = index
    views.register_index(open_index(spark, str(out)))
    row = spark.sql(
        "SELECT count(*) n, max(length(b.body)) longest FROM v_attachments v"
        " JOIN bodies b ON b.maildir_path = v.maildir_path JOIN blobs f ON f.sha256 = v.sha256"
        " JOIN messages m ON m.maildir_path = v.maildir_path WHERE m.direction = 'in'"
    ).first()
    assert (row.n, row.longest) == (4, len("Dear all,\nsee below."))


def test_stream_is_as_complete_as_the_batch(spark, mailbox, tmp_path):
    out, checkpoint = str(tmp_path / "o"), str(tmp_path / "checkpoint")
    deliver(mailbox / "a" / "b" / "c", "_hidden-from-spark", mail("Deep", BASS, DIRECTOR))

    def stream():
        before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
        stream_ingest(spark, str(mailbox), out, checkpoint, MINE).awaitTermination()
        assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
        store = open_index(spark, out)
        return store.read("messages").count(), store.read("blobs").count()

    assert stream() == (6, 4)
    deliver(mailbox / ".Outbox", "x2", mail("More", DIRECTOR, HALL))
    deliver(mailbox, "1205.in", mail("Changed", BASS, DIRECTOR, ((BINARY, b"other", "o"),)), "cur")
    assert stream() == (7, 5)
    # Losing the stream's own checkpoint repeats the scan but not the rows.
    shutil.rmtree(checkpoint)
    assert stream() == (7, 5)


def test_mail_given_as_bytes_is_indexed_alike(spark, index, tmp_path):
    box, out, _ = index
    scanned = source.scan_maildir(spark, str(box)).drop("scan_error")
    files = source.with_file_stats(scanned).drop("read_error")
    raws = source.with_file_bytes(scanned).select("maildir_path", "raw")
    stats = ingest_files(files, str(tmp_path / "b"), MINE, raws=raws).first()
    assert (stats.indexed, stats.new_blobs, stats.errors) == (5, 4, 0)
    ours, theirs = open_index(spark, str(tmp_path / "b")), open_index(spark, str(out))
    for table in ("messages", "attachments", "blobs", "blob_content", "bodies"):
        rows = [sorted(map(str, store.read(table).collect())) for store in (ours, theirs)]
        assert rows[0] == rows[1], table
    again = ingest_files(files, str(tmp_path / "b"), MINE, raws=raws).first()
    assert (again.skipped, again.indexed) == (5, 0)
