"""Storage, waste and type reports, and the same through ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, reports
from ..plans import views
from ..sources import corpus
from . import sql
from .detect import TYPED, typed_occurrences
from .registry import query


@query(
    "storage_by_type",
    f"WITH {TYPED} SELECT sniffed_type, count(*) AS n, CAST(sum(size) // 1048576 AS BIGINT) AS mb"
    " FROM typed GROUP BY 1 ORDER BY mb DESC, sniffed_type NULLS FIRST LIMIT 15",
)
def storage_by_type(spark, sf_dir):
    return reports.storage_by_type(typed_occurrences(spark, sf_dir))


@query(
    "wasted_space",
    f"WITH {sql.OCC} SELECT sha256, arg_min_null(filename, maildir_path) AS filename,"
    " max(size) AS size, count(*) AS copies, max(size) * (count(*) - 1) AS wasted"
    " FROM occ GROUP BY sha256 ORDER BY wasted DESC, sha256 LIMIT 20",
)
def wasted_space(spark, sf_dir):
    return reports.wasted_space(corpus.occurrences(spark, sf_dir))


@query(
    "type_share",
    f"WITH {TYPED}, files AS (SELECT DISTINCT sha256, sniffed_type FROM typed)"
    " SELECT sniffed_type, count(*) AS files,"
    " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM files) AS share FROM files GROUP BY 1",
)
def type_share(spark, sf_dir):
    return reports.type_share(dedup.blob_rows(typed_occurrences(spark, sf_dir)))


PREVIEWABLE = (
    "(kind = 'application/pdf' OR kind LIKE 'image/%' OR kind IN ('text/plain', 'text/html',"
    " 'application/xml', 'text/csv', 'application/json', 'text/calendar'))"
)


@query(
    "preview_coverage",
    f"""WITH {TYPED}, files AS (
  SELECT *, coalesce(sniffed_type, mime_declared, '') AS kind
  FROM ({sql.collapsed("SELECT * FROM typed")}))
SELECT count(*) AS files, count(sniffed_type) AS identified,
  count(*) FILTER (WHERE {PREVIEWABLE}) AS previewable,
  CAST(count(sniffed_type) AS DOUBLE) / count(*) AS identified_share,
  CAST(count(*) FILTER (WHERE {PREVIEWABLE}) AS DOUBLE) / count(*) AS previewable_share
FROM files""",
)
def preview_coverage(spark, sf_dir):
    return reports.preview_coverage(dedup.collapse(typed_occurrences(spark, sf_dir)))


@query(
    "most_repeated",
    f"""WITH {sql.OCC}, top AS (SELECT sha256, count(*) AS copies FROM occ GROUP BY sha256
  ORDER BY copies DESC, sha256 LIMIT 1)
SELECT sha256, copies, size, filename, count(*) AS n, min(year) AS first_year,
  max(year) AS last_year FROM occ JOIN top USING (sha256) GROUP BY ALL""",
)
def most_repeated(spark, sf_dir):
    return reports.most_repeated(corpus.occurrences(spark, sf_dir))


@query(
    "type_mismatch",
    f"WITH {TYPED} SELECT mime_declared, sniffed_type, count(*) AS n FROM typed"
    " WHERE mime_declared IS DISTINCT FROM sniffed_type GROUP BY ALL",
)
def type_mismatch(spark, sf_dir):
    return reports.type_mismatch(typed_occurrences(spark, sf_dir))


@query(
    "adhoc_sql",
    f"""WITH {sql.OCC} SELECT sniffed_type, year, folder, count(*) AS n,
  CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(length(subject)) AS BIGINT) AS chars
FROM occ WHERE direction = 'in' GROUP BY ALL""",
)
def adhoc_sql(spark, sf_dir):
    view = corpus.occurrences(spark, sf_dir)
    messages = view.select(
        "maildir_path", "folder", "direction", "subject", "date_parsed"
    ).distinct()
    attachments = view.select("maildir_path", "part_path", "sha256", "filename")
    views.register_views(messages, attachments, dedup.blob_rows(view), view)
    return spark.sql(
        "SELECT b.sniffed_type, v.year, m.folder, count(*) AS n, sum(b.size) AS bytes,"
        " sum(length(m.subject)) AS chars FROM v_attachments v"
        " JOIN attachments a ON a.maildir_path = v.maildir_path AND a.part_path = v.part_path"
        " JOIN blobs b ON b.sha256 = a.sha256 JOIN messages m ON m.maildir_path = a.maildir_path"
        " WHERE m.direction = 'in' GROUP BY b.sniffed_type, v.year, m.folder"
    )


@query(
    "blob_dedup",
    f"""WITH {sql.OCC}, stored AS (SELECT DISTINCT sha256 FROM occ WHERE i % 3 = 0)
SELECT sha256, max(size) AS size, substr(sha256, 1, 2) || '/' || sha256 AS blob_path,
  max(sniffed_type) AS sniffed_type, max(sniffed_ext) AS sniffed_ext,
  min(maildir_path) AS maildir_path, min(part_path) AS part_path
FROM occ WHERE sha256 NOT IN (SELECT sha256 FROM stored) GROUP BY sha256""",
)
def blob_dedup(spark, sf_dir):
    from ..operators.incremental import unseen

    view = corpus.occurrences(spark, sf_dir)
    stored = view.filter(F.col("doc_id") % 3 == 0).select("sha256").distinct()
    return unseen(dedup.blob_rows(view), stored)
