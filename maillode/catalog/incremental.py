"""Incremental maintenance, file scans and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, dedup, incremental, mime
from ..plans.ingest import IngestOptions
from ..sources import corpus, maildir
from ..streaming import ingest as streams
from . import sql
from .mail import DEEP, DIRECTION, MAIL
from .registry import query

# Of ten documents eight are stored already, one has changed, one is new.
CHANGED, NEW = 8, 9
RUN_LIMIT = 100


def _slot():
    return F.col("doc_id") % 10


def _scanned(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    mtime = (i + F.when(_slot() == CHANGED, 0.5).otherwise(0.0)).cast("double")
    view = corpus.occurrences(spark, sf_dir)
    return view.select("doc_id", "maildir_path", mtime.alias("mtime"), "size")


def _known(spark, sf_dir) -> DataFrame:
    view = corpus.occurrences(spark, sf_dir).filter(_slot() <= CHANGED)
    return view.select("maildir_path", F.col("doc_id").cast("double").alias("mtime"), "size")


@query(
    "incremental_skip",
    f"WITH {sql.OCC} SELECT maildir_path, CAST(i + CASE WHEN i % 10 = {CHANGED} THEN 0.5 ELSE 0 END"
    f" AS DOUBLE) AS mtime, size FROM occ WHERE i % 10 >= {CHANGED}",
)
def incremental_skip(spark, sf_dir):
    todo = incremental.skip_known(_scanned(spark, sf_dir), _known(spark, sf_dir))
    return todo.drop("doc_id")


@query(
    "incremental_limit",
    f"WITH {sql.OCC} SELECT maildir_path FROM occ WHERE i % 10 >= {CHANGED}"
    f" ORDER BY maildir_path LIMIT {RUN_LIMIT}",
)
def incremental_limit(spark, sf_dir):
    todo = incremental.skip_known(_scanned(spark, sf_dir), _known(spark, sf_dir))
    return incremental.first_files(todo, RUN_LIMIT).select("maildir_path")


@query(
    "message_upsert",
    f"WITH {sql.OCC} SELECT maildir_path, folder, CASE WHEN i % 10 >= {CHANGED} THEN 'read again: '"
    " ELSE '' END || subject AS subject FROM occ",
)
def message_upsert(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    columns = ["maildir_path", "folder", "subject"]
    old = view.filter(_slot() <= CHANGED).select(*columns)
    new = view.filter(_slot() >= CHANGED).withColumn(
        "subject", F.concat(F.lit("read again: "), F.col("subject"))
    )
    return incremental.upsert(old, new.select(*columns), "maildir_path")


@query(
    "attachment_replace",
    f"""WITH {sql.OCC}
SELECT maildir_path, part_path, sha256 FROM occ WHERE i % 10 < {CHANGED}
UNION ALL SELECT maildir_path, '3', sha256 FROM occ WHERE i % 10 < {CHANGED}
UNION ALL SELECT maildir_path, '4', sha256 FROM occ WHERE i % 10 >= {CHANGED}""",
)
def attachment_replace(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    stored = view.filter(_slot() <= CHANGED)
    old = stored.withColumn("part_path", F.explode(F.array(F.lit("2"), F.lit("3"))))
    new = view.filter(_slot() >= CHANGED).withColumn("part_path", F.lit("4"))
    columns = ["maildir_path", "part_path", "sha256"]
    return incremental.replace_children(old.select(*columns), new.select(*columns), new)


def _two_runs(spark, sf_dir):
    """What came and went in two runs: the second reads changed mail again, and new mail.

    Before its change a document was another file, in another folder and year, and longer.
    """
    view = corpus.occurrences(spark, sf_dir)
    stale = _slot() == CHANGED
    first = view.filter(_slot() <= CHANGED).withColumns(
        {
            "sha256": F.when(stale, F.sha2("sha256", 256)).otherwise(F.col("sha256")),
            "folder": F.when(stale, ".Drafts").otherwise(F.col("folder")),
            "year": F.when(stale, "1999").otherwise(F.col("year")),
            "size": F.when(stale, F.col("size") + 9).otherwise(F.col("size")),
        }
    )
    return [
        (first, first.filter(F.lit(False))),
        (view.filter(_slot() >= CHANGED), first.filter(stale)),
    ]


@query("maintained_copies", f"WITH {sql.OCC} SELECT sha256, count(*) AS copies FROM occ GROUP BY sha256")
def maintained_copies(spark, sf_dir):
    stored = corpus.scratch(spark, "copies")
    for came, went in _two_runs(spark, sf_dir):
        counts.digest_differences(came, went).write.mode("append").parquet(stored)
    return dedup.digest_counts(spark.read.parquet(stored))


@query(
    "maintained_facets",
    f"""WITH {sql.OCC} SELECT 'year' AS facet, year AS value, count(*) AS n,
  CAST(sum(size) AS BIGINT) AS bytes FROM occ GROUP BY year
UNION ALL SELECT 'folder', folder, count(*), CAST(sum(size) AS BIGINT) FROM occ GROUP BY folder
UNION ALL SELECT 'occurrences', NULL, count(*), CAST(sum(size) AS BIGINT) FROM occ HAVING count(*) > 0
UNION ALL SELECT 'messages', NULL, count(*), 0 FROM occ HAVING count(*) > 0""",
)
def maintained_facets(spark, sf_dir):
    stored = corpus.scratch(spark, "facets")
    for came, went in _two_runs(spark, sf_dir):
        # Every message has one part here; the files are counted by ``maintained_copies``.
        files = came.filter(F.lit(False))
        changed = counts.facet_differences(came, went, came, went, files)
        changed.write.mode("append").parquet(stored)
    return counts.facet_counts(spark.read.parquet(stored))


@query(
    "ingest_stats",
    f"""WITH {MAIL}, todo AS (SELECT * FROM m WHERE i % 10 >= {CHANGED}),
parsed AS (SELECT * FROM todo WHERE i % 15 NOT IN (6, 11) AND NOT {DEEP}),
att AS (SELECT sha256 FROM attached WHERE i IN (SELECT i FROM parsed WHERE i % 15 <> 1)),
stored AS (SELECT sha256(b) AS sha256 FROM m WHERE i % 10 <= {CHANGED}),
fresh AS (SELECT DISTINCT sha256 FROM att WHERE sha256 NOT IN (SELECT sha256 FROM stored))
SELECT (SELECT count(*) FROM m) AS scanned, (SELECT count(*) FROM parsed) AS indexed,
  (SELECT count(*) FROM m WHERE i % 10 < {CHANGED}) AS skipped,
  (SELECT count(*) FROM att) AS attachments, (SELECT count(*) FROM fresh) AS new_blobs,
  (SELECT count(*) FROM att) - (SELECT count(*) FROM fresh) AS dup_blobs,
  (SELECT count(*) FROM todo WHERE i % 15 IN (6, 11) OR {DEEP}) AS errors""",
)
def ingest_stats(spark, sf_dir):
    scanned = corpus.broken_mail(spark, sf_dir)
    changed = F.col("mtime") + F.when(_slot() == CHANGED, 0.5).otherwise(0.0)
    known = scanned.filter(_slot() <= CHANGED).withColumn("mtime", changed)
    todo = incremental.skip_known(scanned, known)
    # Several tables are derived from one parse, so it is written once.
    staged = corpus.scratch(spark, "ingest-stats")
    mime.parse_messages(todo).write.parquet(staged)
    parsed = spark.read.parquet(staged)
    attachments = mime.attachment_rows(parsed)
    stored = corpus.occurrences(spark, sf_dir).filter(_slot() <= CHANGED)
    fresh = incremental.unseen(dedup.blob_rows(attachments), stored.select("sha256"))
    listed = scanned.select("maildir_path", F.lit(None).cast("string").alias("read_error"))
    return incremental.run_statistics(listed, todo, parsed, attachments, fresh)


@query(
    "blob_contents",
    f"WITH {MAIL} SELECT DISTINCT sha256, sha256 AS content_sha256, size AS bytes FROM attached",
)
def blob_contents(spark, sf_dir):
    from ..plans.ingest import blob_contents as contents_of

    messages = corpus.mail(spark, sf_dir)
    blobs = dedup.blob_rows(mime.attachment_rows(mime.parse_messages(messages)))
    contents = contents_of(blobs, raws=messages.select("maildir_path", "raw"))
    return contents.select(
        "sha256",
        F.sha2("content", 256).alias("content_sha256"),
        F.octet_length("content").cast("long").alias("bytes"),
    )


@query(
    "stored_files",
    f"""WITH {sql.OCC}, f AS (SELECT sha256, min(maildir_path) AS path, any_value(text) AS text,
    any_value(o.sniffed_type) AS sniffed_type, max(size) AS size, any_value(sniffed_ext) AS ext
  FROM occ o JOIN docs USING (i) GROUP BY sha256),
n AS (SELECT sha256, arg_min(filename, maildir_path) AS filename FROM occ
  WHERE filename IS NOT NULL GROUP BY sha256)
SELECT sha256, size, sniffed_type, coalesce(filename, left(sha256, 12) || '.' || coalesce(ext, 'bin'))
    AS download_name, CASE WHEN sniffed_type LIKE 'text/%' THEN text END AS text,
  CASE WHEN sniffed_type LIKE 'text/%' THEN 'utf-8' END AS charset,
  CASE WHEN sniffed_type LIKE 'text/%' THEN size > 262144 END AS truncated
FROM f LEFT JOIN n USING (sha256)""",
)
def stored_files(spark, sf_dir):
    from ..plans.views import readable_files

    view = corpus.occurrences(spark, sf_dir)
    blobs = dedup.blob_rows(view)
    texts = corpus.table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.encode("text", "UTF-8").alias("content")
    )
    contents = texts.groupBy("sha256").agg(F.any_value("content").alias("content"))
    return readable_files(contents, blobs, view)


@query(
    "maildir_scan",
    f"WITH {MAIL} SELECT substr(maildir_path, 7) AS file, folder, 1362000000.0::DOUBLE AS mtime,"
    " sha256(b) AS sha256 FROM m",
)
def maildir_scan(spark, sf_dir):
    root = corpus.scratch(spark, "maildir")
    corpus.write_files(corpus.document_files(spark, sf_dir), root)
    found = maildir.with_file_stats(maildir.scan_maildir(spark, root)).drop("read_error")
    contents = maildir.with_file_bytes(found)
    return contents.select(
        F.substring("maildir_path", len(root) + 2, 1 << 30).alias("file"),
        "folder",
        "mtime",
        F.sha2("raw", 256).alias("sha256"),
    )


@query(
    "stream_ingest",
    f"""WITH {MAIL} SELECT substr(m.maildir_path, 7) AS file, folder, {DIRECTION} AS direction,
  part_path, sha256, size, bytes FROM m JOIN
  (SELECT maildir_path, part_path, sha256, size, octet_length(c) AS bytes FROM attached) a
  ON a.maildir_path = m.maildir_path""",
)
def stream_ingest(spark, sf_dir):
    base = corpus.scratch(spark, "stream-ingest")
    root, out = f"{base}/mail", f"{base}/index"
    mail = corpus.mail(spark, sf_dir)
    options = IngestOptions(me=corpus.OWNER)
    # Two runs over a growing directory: the second sees only what came since.
    for share in (F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0):
        corpus.write_files(mail.filter(share), root)
        run = streams.stream_ingest(spark, root, out, f"{base}/checkpoint", options)
        run.awaitTermination()
    from ..plans.store import open_index
    from ..plans.views import stored_occurrences

    store = open_index(spark, out)
    contents = store.read("blob_content").select(
        "sha256", F.octet_length("content").cast("long").alias("bytes")
    )
    view = dedup.join_unique(stored_occurrences(store), contents, "sha256")
    return view.select(
        F.substring("maildir_path", len(root) + 2, 1 << 30).alias("file"),
        "folder",
        "direction",
        "part_path",
        "sha256",
        "size",
        "bytes",
    )


@query(
    "stream_first_seen",
    f"WITH {sql.OCC} SELECT sha256, max(size) AS size FROM occ GROUP BY sha256",
)
def stream_first_seen(spark, sf_dir):
    base = corpus.scratch(spark, "first-seen")
    schema = corpus.table(spark, sf_dir, "documents").schema
    # The pattern lets the table be one file or a directory of files.
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    occurrences = documents.select(
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size")
    )
    run = streams.stream_first_seen(occurrences, f"{base}/digests", f"{base}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{base}/digests").select("sha256", "size")
