"""MIME explode, headers, dates, direction and bodies, over composed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import mime
from ..sources import corpus
from . import sql
from .registry import query

MIN_SIZE = 12

LONG_TAIL = """CASE WHEN i % 250 = 10
  THEN repeat(chr(13) || chr(10) || 'noch eine Zeile', 14000) ELSE '' END"""

OWN_TEXT = f"'Grüße ' || i || chr(10) || chr(10) || text || {LONG_TAIL}"

# Closed forms of what corpus.mail composes around each document.
MAIL = f"""
docs AS (SELECT doc_id AS i, CAST(substr(source, 4) AS BIGINT) AS n, encode(text) AS b,
  text, regexp_extract(text, '[a-z]+') AS word FROM documents),
mail AS (SELECT *, {sql.FOLDER_LIST}[n % 8 + 1] AS folder FROM docs),
m AS (SELECT *, '/mail/' || CASE WHEN folder = 'INBOX' THEN '' ELSE folder || '/' END || 'cur/'
  || CASE WHEN i % 4 = 2 THEN 'd' || i || '.x' ELSE (1362000000 + i) || '.d' || i END
  AS maildir_path FROM mail),
parts AS (
  SELECT i, maildir_path, '1' AS part_path,
    CASE WHEN i % 9 = 1 THEN 'text/html' ELSE 'text/plain' END AS content_type,
    CASE WHEN i % 9 = 3 THEN 'attachment' END AS disposition,
    NULL AS declared_name, NULL AS content_id,
    CASE i % 9 WHEN 1 THEN encode('<style>p{{}}</style><p>Hallo &amp; ' || i || '</p>')
      WHEN 2 THEN '\\x47\\x72\\xFC\\xDF\\x65\\x20'::BLOB || encode(CAST(i AS VARCHAR))
      WHEN 3 THEN encode('note') ELSE encode({OWN_TEXT}) END AS c
  FROM m
  UNION ALL
  SELECT i, maildir_path, '2', 'application/octet-stream',
    CASE WHEN i % 7 <> 0 THEN 'attachment' END,
    CASE WHEN i % 7 <> 0 THEN 'd' || i || '.bin' END,
    CASE WHEN i % 7 = 0 THEN '<img' || i || '@x>' END, b FROM m
  UNION ALL
  SELECT i, maildir_path, '3', 'message/rfc822', NULL, NULL, NULL, NULL FROM m WHERE i % 6 < 2
  UNION ALL
  SELECT i, maildir_path, '3.1', 'text/plain', NULL, NULL, NULL, encode('inner text')
  FROM m WHERE i % 6 = 0
  UNION ALL
  SELECT i, maildir_path, '3.2', 'application/x-inner', 'inline', 'in' || i || '.dat', NULL,
    encode('inner ' || i) FROM m WHERE i % 6 = 0
  UNION ALL
  SELECT i, maildir_path, '3.', 'application/pdf', NULL, NULL, NULL, encode('%PDF-1.4 ' || i)
  FROM m WHERE i % 6 = 1
),
attached AS (SELECT *, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS sha256,
    {sql.sniff_case("c", 2)} AS ext FROM parts
  WHERE (part_path IN ('2', '3.2', '3.') OR part_path = '1' AND i % 9 = 3)
    AND octet_length(c) >= 1)"""

PART_SQL = (
    "SELECT maildir_path, part_path, content_type, disposition, declared_name AS filename_raw,"
    " content_id, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS sha256,"
    " c IS NULL AS decode_failed FROM parts"
)


def _parsed(spark, sf_dir, parts=None, bodies=False, malformed=False) -> DataFrame:
    return mime.parse_messages(
        corpus.mail(spark, sf_dir, malformed),
        parts=parts,
        bodies=bodies,
        headers_only=not (parts or bodies),
    )


def _part_columns(spark, sf_dir) -> DataFrame:
    wanted = (
        "part_path", "content_type", "disposition", "filename_raw", "content_id", "size", "sha256",
        "decode_failed",
    )
    parts = mime.explode_parts(_parsed(spark, sf_dir, "meta"))
    return parts.select("maildir_path", *[f"part.{c}" for c in wanted])


@query("mime_parts", f"WITH {MAIL} {PART_SQL}")
def mime_parts(spark, sf_dir):
    return _part_columns(spark, sf_dir)


@query("mime_nested", f"WITH {MAIL} {PART_SQL} WHERE part_path LIKE '3%'")
def mime_nested(spark, sf_dir):
    return _part_columns(spark, sf_dir).filter(F.startswith("part_path", F.lit("3")))


@query("attachment_filter", f"WITH {MAIL} SELECT maildir_path, part_path, sha256 FROM attached")
def attachment_filter(spark, sf_dir):
    attachments = mime.attachment_rows(_parsed(spark, sf_dir, "meta"))
    return attachments.select("maildir_path", "part_path", "sha256")


@query(
    "min_size_filter",
    f"WITH {MAIL} SELECT maildir_path, part_path, size FROM attached WHERE size >= {MIN_SIZE}",
)
def min_size_filter(spark, sf_dir):
    attachments = mime.attachment_rows(_parsed(spark, sf_dir, "meta"), MIN_SIZE)
    return attachments.select("maildir_path", "part_path", "size")


@query(
    "filename_fallback",
    f"""WITH {MAIL} SELECT maildir_path, part_path, declared_name AS filename_raw,
  coalesce(declared_name, CASE WHEN content_id IS NOT NULL
    THEN 'img' || i || coalesce('.' || ext, '') END) AS filename FROM attached""",
)
def filename_fallback(spark, sf_dir):
    attachments = mime.attachment_rows(_parsed(spark, sf_dir, "meta"))
    return attachments.select("maildir_path", "part_path", "filename_raw", "filename")


@query(
    "message_body",
    rf"""WITH {MAIL}, plain AS (SELECT *, CASE WHEN i % 9 = 2 THEN 'Grüße ' || i
    WHEN i % 9 NOT IN (1, 3) THEN {OWN_TEXT} END AS own,
  CASE WHEN i % 6 = 0 THEN 'inner text' END AS inner_text FROM m),
whole AS (SELECT maildir_path, coalesce(regexp_replace(coalesce(
    own || chr(10) || chr(10) || inner_text, own, inner_text), '[{sql.SPACES}]+$', ''),
  CASE WHEN i % 9 = 1 THEN 'Hallo & ' || i
    WHEN i % 10 = 3 THEN '[this message''s text can''t be read: string index out of range]' END,
  '[nothing to read in this message]') AS body FROM plain)
SELECT maildir_path, sha256(body) AS body_sha256, length(body) AS chars,
  left(body, 200000) AS shown, length(body) > 200000 AS truncated FROM whole""",
)
def message_body(spark, sf_dir):
    """Some messages have a part beside their texts whose headers can't be read."""
    bodies = mime.body_rows(_parsed(spark, sf_dir, bodies=True, malformed=True))
    shown, cut = text.cut_body(F.col("body"))
    return bodies.select(
        "maildir_path",
        F.sha2("body", 256).alias("body_sha256"),
        F.length("body").cast("long").alias("chars"),
        shown.alias("shown"),
        cut.alias("truncated"),
    )


FROM_ADDR = """CASE WHEN i % 13 = 5 THEN NULL WHEN i % 5 = 0 THEN 'owner@mine.example'
  WHEN i % 7 = 3 AND word <> '' THEN word || '@words.example'
  ELSE 'p' || (i % 11) || '@mail.example.com' END"""


@query("first_address", f"WITH {MAIL} SELECT maildir_path, {FROM_ADDR} AS from_addr FROM m")
def first_address(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed.select("maildir_path", mime.first_address(F.col("from_addrs")).alias("from_addr"))


@query(
    "all_addresses",
    f"""WITH {MAIL} SELECT maildir_path, array_to_string(list_sort(list_filter([
  'x@else.example', CASE WHEN i % 3 = 0 THEN 'me@mine.example' END,
  CASE WHEN i % 4 = 2 AND word <> '' THEN 'to.' || word || '@words.example' END,
  CASE WHEN i % 4 = 1 THEN 'c' || (i % 3) || '@cc.example' END,
  CASE WHEN i % 5 = 2 THEN 'box@mine.example' END], lambda x: x IS NOT NULL)), ' ') AS recipients
FROM m""",
)
def all_addresses(spark, sf_dir):
    found = mime.all_addresses(F.col("to_addrs"))
    return _parsed(spark, sf_dir).select(
        "maildir_path", F.array_join(found, " ").alias("recipients")
    )


DIRECTION = """CASE WHEN i % 5 = 0 AND i % 13 <> 5 THEN 'out' WHEN i % 3 = 0 OR i % 5 = 2 THEN 'in'
  WHEN folder IN ('.Gesendet', '.Sent Messages') THEN 'out'
  WHEN i % 13 <> 5 THEN 'in' ELSE 'unknown' END"""


@query("direction", f"WITH {MAIL} SELECT maildir_path, {DIRECTION} AS direction FROM m")
def direction(spark, sf_dir):
    messages = mime.message_rows(_parsed(spark, sf_dir), corpus.OWNER)
    return messages.select("maildir_path", "direction")


DAY = "(1 + i % 28)::INT"
DATED = f"""SELECT maildir_path,
  CASE i % 8
    WHEN 0 THEN strftime(make_date(2013, 3, {DAY}), '%a, %d %b %Y 09:15:00 +0100')
    WHEN 4 THEN strftime(make_date(2013, 3, {DAY}), '%a, %d %b %Y 09:15:00 -0000')
    WHEN 1 THEN strftime(make_date(1970, 1, {DAY}), '%a, %d %b %Y 00:00:00 +0000')
    WHEN 6 THEN strftime(make_date(2100, 12, {DAY}), '%a, %d %b %Y 23:59:59 +0000')
    WHEN 3 THEN NULL WHEN 7 THEN NULL ELSE 'not a date at all' END AS date_raw,
  CASE i % 8 WHEN 0 THEN strftime(make_date(2013, 3, {DAY}), '%Y-%m-%dT09:15:00+01:00')
    WHEN 4 THEN strftime(make_date(2013, 3, {DAY}), '%Y-%m-%dT09:15:00')
    ELSE CASE WHEN i % 4 <> 2 THEN strftime(make_timestamp((1362000000 + i) * 1000000),
           '%Y-%m-%dT%H:%M:%S+00:00')
         WHEN folder = '.Archives.2007' THEN '2007-01-01T00:00:00+00:00'
         WHEN folder = '.Projects.2013.Inbox' THEN '2013-01-01T00:00:00+00:00' END
    END AS date_parsed,
  CASE WHEN i % 4 = 0 THEN 'header' WHEN i % 4 <> 2 THEN 'filename'
       WHEN folder IN ('.Archives.2007', '.Projects.2013.Inbox') THEN 'folder'
       ELSE 'none' END AS date_source FROM m"""


@query(
    "direction_rederived",
    f"""WITH {MAIL} SELECT maildir_path, CASE WHEN i % 13 <> 5 AND i % 5 <> 0 AND i % 11 = 3
    AND NOT (i % 7 = 3 AND word <> '') THEN 'out' WHEN i % 4 = 1 AND i % 3 = 2 THEN 'in'
    WHEN folder IN ('.Gesendet', '.Sent Messages') THEN 'out'
    WHEN i % 13 <> 5 THEN 'in' ELSE 'unknown' END AS direction FROM m""",
)
def direction_rederived(spark, sf_dir):
    """Stored messages, decided anew for another owner."""
    from ..plans.views import rederive_direction

    messages = mime.message_rows(_parsed(spark, sf_dir), corpus.OWNER)
    anew = rederive_direction(messages, ("p3@mail.example.com", "c2@cc.example"))
    return anew.select("maildir_path", "direction")


@query("date_ladder", f"WITH {MAIL} {DATED}")
def date_ladder(spark, sf_dir):
    messages = mime.message_rows(_parsed(spark, sf_dir), corpus.OWNER)
    return messages.select("maildir_path", "date_raw", "date_parsed", "date_source")


DEEP = "i % 125 = 63"


@query(
    "parse_errors",
    f"""WITH {MAIL} SELECT maildir_path,
  CASE WHEN i % 15 = 11 THEN 'no bytes' END AS read_error,
  CASE WHEN {DEEP} THEN 'unparseable: RecursionError'
    WHEN i % 15 = 1 THEN 'compat32 fallback: IndexError(''string index out of range'')' END
    AS parse_error,
  CASE WHEN i % 15 = 6 THEN 'IndexError(''list index out of range'')' END AS index_error,
  CASE WHEN {DEEP} THEN 'unknown' WHEN i % 15 NOT IN (6, 11) THEN CASE WHEN i % 15 = 1 THEN
    CASE WHEN folder IN ('.Gesendet', '.Sent Messages') THEN 'out' ELSE 'in' END
    ELSE {DIRECTION} END END AS direction
FROM m""",
)
def parse_errors(spark, sf_dir):
    parsed = mime.parse_messages(corpus.broken_mail(spark, sf_dir), parts=None)
    # What a row that could be indexed says, and why the others could not.
    kept = ("read_error", "index_error")
    stored = mime.message_rows(parsed, corpus.OWNER).select("maildir_path", "direction")
    # How deep is too deep the interpreter words in several ways.
    note = F.regexp_replace("parse_error", r"RecursionError\(.*", "RecursionError")
    notes = parsed.select("maildir_path", note.alias("parse_error"), *kept)
    return notes.join(stored, "maildir_path", "left")
