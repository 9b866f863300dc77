"""The three-table join and the message views, over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import views
from ..sources import corpus
from . import sql
from .registry import query

TABLES = f"""turns AS (
  SELECT '/mail/cur/c' || conv_id AS maildir_path, CAST(turn AS VARCHAR) AS part_path,
    sha256(text) AS sha256, role || '-' || turn AS filename, 'text/plain' AS mime_declared,
    CAST(octet_length(encode(text)) AS BIGINT) AS size, conv_id, text
  FROM conversations),
attachments AS (SELECT maildir_path, part_path, sha256, filename, mime_declared FROM turns),
blobs AS (SELECT sha256, max(size) AS size FROM turns GROUP BY sha256),
messages AS (SELECT DISTINCT maildir_path, {sql.FOLDER_LIST}[conv_id % 8 + 1] AS folder,
  'Conversation ' || conv_id AS subject,
  (2002 + conv_id % 12) || '-01-01T00:00:00+00:00' AS date_parsed FROM turns)"""


@query(
    "occurrence_view",
    f"WITH {TABLES} SELECT *, substr(date_parsed, 1, 4) AS year FROM attachments"
    " JOIN blobs USING (sha256) JOIN messages USING (maildir_path)",
)
def occurrence_view(spark, sf_dir):
    return views.occurrence_view(*corpus.occurrence_tables(spark, sf_dir))


@query(
    "message_detail",
    f"""WITH {TABLES}, bodies AS (SELECT maildir_path, text AS body FROM turns
  WHERE part_path = '0')
SELECT maildir_path, part_path, folder, subject, date_parsed, sha256(body) AS body_sha256,
  length(body) AS chars, left(body, 200000) AS shown, length(body) > 200000 AS truncated
FROM attachments JOIN messages USING (maildir_path) LEFT JOIN bodies USING (maildir_path)""",
)
def message_detail(spark, sf_dir):
    attachments, _, messages = corpus.occurrence_tables(spark, sf_dir)
    turns = corpus.table(spark, sf_dir, "conversations")
    bodies = turns.filter("turn = 0").select(
        F.concat(F.lit(f"{corpus.MAIL_ROOT}/cur/c"), F.col("conv_id")).alias("maildir_path"),
        F.col("text").alias("body"),
    )
    missing = [c for c in views.HEAD_COLUMNS if c not in messages.columns]
    whole = messages.withColumns({c: F.lit(None).cast("string") for c in missing})
    heads = views.message_heads(attachments, whole, bodies)
    return heads.select(
        "maildir_path", "part_path", "folder", "subject", "date_parsed", "body_sha256", "chars",
        F.col("body").alias("shown"), "truncated",
    )


@query(
    "message_siblings",
    f"""WITH {TABLES}, opened AS (SELECT DISTINCT maildir_path FROM attachments
  WHERE filename LIKE 'assistant-%')
SELECT maildir_path, part_path, filename, mime_declared, size, sha256 FROM attachments
  JOIN blobs USING (sha256) WHERE maildir_path IN (SELECT maildir_path FROM opened)""",
)
def message_siblings(spark, sf_dir):
    attachments, blobs, _ = corpus.occurrence_tables(spark, sf_dir)
    opened = attachments.filter(F.startswith("filename", F.lit("assistant-")))
    return views.message_parts(opened, attachments, blobs)
