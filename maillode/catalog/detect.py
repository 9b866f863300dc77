"""Type detection, character sets, markup, names: scalar work on content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers, names, sniff, text
from ..operators import dedup, reports
from ..sources import corpus
from . import sql
from .registry import query

# Leading bytes put before each document, in hexadecimal: every fixed prefix,
# the container formats, near misses, and text that starts like markup.
MAGIC = (
    *(prefix for prefix, _, _ in sniff.PREFIXES),
    *("00000020" + b.encode().hex().upper() for b in sniff.MP4_BRANDS),
    "00000020" + b"ftypheic".hex().upper(),
    *("5249464600000000" + f.encode().hex().upper() for f, _, _ in sniff.RIFF_FORMS),
    "5249464600000000" + b"ACON".hex().upper(),
    b" \t\n<?XML ".hex().upper(),
    b"\x0b\x0c<HtMl ".hex().upper(),
    b"<!DOCTYPE ".hex().upper(),
    b"<!doc ".hex().upper(),
    "00FF00FE",
    "0000",
    "",
)
MAGIC_SQL = "[" + ", ".join(f"'{m}'" for m in MAGIC) + "]"
DOCS = """docs AS (SELECT doc_id AS i, text, encode(text) AS b FROM documents)"""


def _documents(spark, sf_dir) -> DataFrame:
    documents = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.withColumnRenamed("doc_id", "i")


def _pages(spark, sf_dir) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", "html")


def _sniffed(contents: DataFrame) -> DataFrame:
    """The other columns and the detected type of the content in ``c``."""
    others = [c for c in contents.columns if c != "c"]
    return contents.select(*others, sniff.sniff("c").alias("k")).select(*others, "k.*")


def _magic(i: Column) -> Column:
    return F.unhex(F.element_at(F.array(*map(F.lit, MAGIC)), (i % len(MAGIC) + 1).cast("int")))


def typed_occurrences(spark, sf_dir) -> DataFrame:
    """The occurrence view with leading bytes of many formats, and awkward names."""
    i = F.col("doc_id")
    odd_name = F.when(i % 5 == 0, F.format_string('a"b/c\\d\u200b\n\xa0%d.text', i)).when(
        i % 5 == 1, F.concat(F.lit("long "), F.repeat(F.lit("x"), 130))
    )
    name = F.when(i % 3 != 2, F.coalesce(odd_name, "filename"))
    return corpus.occurrences(spark, sf_dir, _magic(i)).withColumn("filename", name)


TYPED = f"""{sql.OCC},
magic AS (
  SELECT o.* EXCLUDE (sha256, size, sniffed_type, sniffed_ext, filename),
    filename AS plain_name, unhex({MAGIC_SQL}[o.i % {len(MAGIC)} + 1]) || d.b AS c
  FROM occ o JOIN docs d USING (i)
),
typed AS (
  SELECT * EXCLUDE (c, plain_name), sha256(c) AS sha256, CAST(octet_length(c) AS BIGINT) AS size,
    {sql.sniff_case("c", 1)} AS sniffed_type, {sql.sniff_case("c", 2)} AS sniffed_ext,
    CASE WHEN i % 3 = 2 THEN NULL
         WHEN i % 5 = 0 THEN 'a"b/c\\d' || chr(8203) || chr(10) || chr(160) || i || '.text'
         WHEN i % 5 = 1 THEN 'long ' || repeat('x', 130)
         ELSE plain_name END AS filename
  FROM magic
)"""


@query(
    "sniff_types",
    f"WITH {DOCS}, t AS (SELECT i, unhex({MAGIC_SQL}[i % {len(MAGIC)} + 1]) || b AS c FROM docs)"
    f" SELECT i, {sql.sniff_case('c', 1)} AS sniffed_type,"
    f" {sql.sniff_case('c', 2)} AS sniffed_ext FROM t",
)
def sniff_types(spark, sf_dir):
    content = F.concat(_magic(F.col("i")), F.encode("text", "UTF-8"))
    return _sniffed(_documents(spark, sf_dir).select("i", content.alias("c")))


ZIP_FILLER = 5000


@query(
    "sniff_zip",
    f"""WITH {DOCS}, t AS (SELECT i,
  unhex(['504B0304', '504B0506', '504B0708', '504B0102'][i % 4 + 1])
  || CASE WHEN i % 7 = 0 THEN encode(repeat('x', {ZIP_FILLER})) ELSE ''::BLOB END
  || encode(['mimetypeapplication/vnd.oasis.opendocument', 'word/', 'xl/', 'ppt/', 'META-INF/']
     [i % 5 + 1]) || b AS c FROM docs)
SELECT i, {sql.sniff_case("c", 1)} AS sniffed_type, {sql.sniff_case("c", 2)} AS sniffed_ext FROM t""",
)
def sniff_zip(spark, sf_dir):
    i = F.col("i")

    def pick(*values):
        return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))

    head = F.unhex(pick(*sniff.ZIP_HEADS, "504B0102"))
    filler = F.when(i % 7 == 0, F.repeat(F.lit("x"), ZIP_FILLER)).otherwise("")
    marker = pick(*(m for m, _, _ in sniff.ZIP_MARKERS), "META-INF/")
    tail = F.encode(F.concat(filler, marker, F.col("text")), "UTF-8")
    return _sniffed(_documents(spark, sf_dir).select("i", F.concat(head, tail).alias("c")))


@query(
    "sniff_text",
    f"""WITH t AS (SELECT 'doc' AS origin, doc_id AS i, encode(text) AS c FROM documents
  UNION ALL SELECT 'page', page_id, encode(html) FROM pages)
SELECT origin, i, {sql.sniff_case("c", 1)} AS sniffed_type,
  {sql.sniff_case("c", 2)} AS sniffed_ext FROM t""",
)
def sniff_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    contents = _documents(spark, sf_dir).select(
        F.lit("doc").alias("origin"), "i", F.encode("text", "UTF-8").alias("c")
    ).unionByName(
        pages.select(
            F.lit("page").alias("origin"),
            F.col("page_id").alias("i"),
            F.encode("html", "UTF-8").alias("c"),
        )
    )
    return _sniffed(contents)


# --- character sets ----------------------------------------------------------

HIGH = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in text.CP1252_HOLES)
HIGH_SQL = "".join(f"\\x{{{ord(c):04x}}}" for c in HIGH)
IN_LATIN1 = r"^[\x00-\x7f\xa0-\xff]*\z"
IN_CP1252 = rf"^[\x00-\x7f\xa0-\xff{HIGH}]*\z"


def recoded_documents(spark, sf_dir) -> DataFrame:
    """Documents as bytes: some in cp1252, some with a byte only latin-1 accepts."""
    i, words = F.col("i"), F.col("text")
    low = "".join(chr(b) for b in range(0x80, 0xA0) if b not in text.CP1252_HOLES)
    single = F.encode(F.translate(words, HIGH, low), "ISO-8859-1")
    with_hole = F.concat(single, F.lit(b"\x81"))
    content = (
        F.when((i % 5 == 1) & words.rlike(IN_LATIN1), with_hole)
        .when((i % 2 == 0) & words.rlike(IN_CP1252), single)
        .otherwise(F.encode(words, "UTF-8"))
    )
    return _documents(spark, sf_dir).select("i", content.alias("content"))


RECODED = rf"""recoded AS (
  SELECT doc_id AS i,
    CASE WHEN doc_id % 5 = 1 AND regexp_full_match(text, '[\x00-\x7f\x{{a0}}-\x{{ff}}\n]*')
           THEN 'latin-1'
         WHEN doc_id % 2 = 0 AND regexp_matches(text, '[^\x00-\x7f]')
           AND regexp_full_match(text, '[\x00-\x7f\x{{a0}}-\x{{ff}}{HIGH_SQL}\n]*') THEN 'cp1252'
         ELSE 'utf-8' END AS encoding,
    text
  FROM documents)"""


@query(
    "charset_ladder",
    f"WITH {RECODED} SELECT i, encoding,"
    " text || CASE encoding WHEN 'latin-1' THEN chr(129) ELSE '' END AS text FROM recoded",
)
def charset_ladder(spark, sf_dir):
    content = F.col("content")
    return recoded_documents(spark, sf_dir).select(
        "i", text.charset_of(content).alias("encoding"), text.decode_ladder(content).alias("text")
    )


@query(
    "charset_counts",
    f"WITH {RECODED} SELECT encoding, count(*) AS files FROM recoded GROUP BY encoding",
)
def charset_counts(spark, sf_dir):
    return reports.charset_counts(recoded_documents(spark, sf_dir))


# --- markup ------------------------------------------------------------------



def text_of_html(column: str) -> str:
    """Reference SQL for the entities the test pages hold."""
    steps = [
        (r"(?is)<script\b.*?</script>", " "),
        (r"(?is)<style\b.*?</style>", " "),
        (rf"(?i)<[{sql.SPACES}]*(br|/p|/div|/tr|/h[1-6])\b[^>]*>", "\n"),
        (r"<[^>]+>", ""),
        (r"&copy;?", "©"),
        (r"&middot;?", "·"),
        (r"&quot;?", '"'),
        (r"&amp;?", "&"),
        (r"\n{3,}", "\n\n"),
        (rf"^[{sql.SPACES}]+", ""),
        (rf"[{sql.SPACES}]+$", ""),
    ]
    for pattern, replacement in steps:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


@query("html_to_text", f"SELECT page_id, {text_of_html('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


LONG = "page_id % 25 = 3 AND regexp_full_match(html, '[\\x00-\\x7f\\n]*')"
REPEATS = 200


@query(
    "text_view",
    f"""WITH stored AS (
  SELECT page_id, CASE WHEN {LONG} THEN repeat(html, {REPEATS}) ELSE html END AS html FROM pages),
cut AS (SELECT page_id, octet_length(encode(html)) > {text.TEXT_VIEW_BYTES} AS truncated,
  CASE WHEN octet_length(encode(html)) > {text.TEXT_VIEW_BYTES}
       THEN left(html, {text.TEXT_VIEW_BYTES}) ELSE html END AS html FROM stored)
SELECT page_id, CASE WHEN page_id % 2 = 1 THEN {text_of_html("html")} ELSE html END AS text,
  'utf-8' AS charset, truncated FROM cut""",
)
def text_view(spark, sf_dir):
    html, page = F.col("html"), F.col("page_id")
    long_page = (page % 25 == 3) & html.rlike(r"^[\x00-\x7f]*\z")
    stored = F.when(long_page, F.repeat(html, REPEATS)).otherwise(html)
    kind = F.when(page % 2 == 1, "text/html").otherwise("text/plain")
    pages = _pages(spark, sf_dir).select(
        "page_id", F.encode(stored, "UTF-8").alias("content"), kind.alias("kind")
    )
    shown = text.text_view(F.col("content"), F.col("kind"))
    return pages.select("page_id", shown.alias("v")).select("page_id", "v.*")


# --- headers and names -------------------------------------------------------


@query(
    "clean_text",
    rf"""WITH dirty AS (SELECT doc_id, replace(text, chr(0), '') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE nullif(trim(regexp_replace(
  replace(t, '. ', '. '), '[{sql.SPACES}]+', ' ', 'g'), ' '), '') END AS cleaned FROM dirty""",
)
def clean_text(spark, sf_dir):
    dirty = F.concat(
        F.lit("\u2003\x00\t "), F.replace("text", F.lit(". "), F.lit(".\x00 \u00a0\x1f\n\x00")),
        F.lit("\r\n\x00\u3000"),
    )
    blank = F.lit(" \x00\t\u2009 ")
    i = F.col("i")
    kept = F.when(i % 50 == 7, blank).otherwise(dirty)
    return _documents(spark, sf_dir).select(i.alias("doc_id"), text.clean(kept).alias("cleaned"))


Q_WORD = r"regexp_replace(hex(encode(t)), '(..)', '=\1', 'g') || '?='"


@query(
    "header_decode",
    rf"""WITH w AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN nullif(regexp_replace(t, '^[{sql.SPACES}]+|[{sql.SPACES}]+$', '', 'g'), '')
  WHEN 1 THEN regexp_replace('Re: ' || t, '[{sql.SPACES}]+$', '')
  WHEN 2 THEN '=?bogus-charset?q?' || {Q_WORD}
  ELSE 'Grüße ' || doc_id || t || t || ' .' END AS decoded FROM w""",
)
def header_decode(spark, sf_dir):
    """Whole texts as encoded words of both kinds, of no known character set, and beside others."""
    i = F.col("i")
    whole = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    b_word = F.concat(F.lit("=?utf-8?b?"), whole, F.lit("?="))
    quoted = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1")
    q_word = F.concat(F.lit("=?UTF-8?Q?"), quoted, F.lit("?="))
    raw = (
        F.when(i % 4 == 0, b_word)
        .when(i % 4 == 1, F.concat(F.lit("Re: "), b_word))
        .when(i % 4 == 2, F.concat(F.lit(" =?bogus-charset?q?"), quoted, F.lit("?= ")))
        .otherwise(
            F.concat(
                F.format_string("=?iso-8859-1?q?Gr=FC=DFe_%d?= ", i),
                q_word, F.lit("\r\n "), b_word, F.lit("."),
            )
        )
    )
    mail = _documents(spark, sf_dir).select(i.alias("doc_id"), raw.alias("raw"))
    return mail.select("doc_id", headers.decode_words(F.col("raw")).alias("decoded"))


@query(
    "folder_of",
    f"""WITH {sql.OCC}, pathed AS (
  SELECT maildir_path AS path FROM occ
  UNION ALL SELECT '/mail' || CASE WHEN strpos(substr(url, 9), '/') > 0
    THEN substr(url, strpos(substr(url, 9), '/') + 8) ELSE '/cur' END FROM pages),
split AS (SELECT path, string_split(substr(path, 7), '/') AS p FROM pathed)
SELECT path, CASE WHEN len(p) >= 3 THEN p[1] ELSE 'INBOX' END AS folder FROM split""",
)
def folder_of(spark, sf_dir):
    slash = F.locate("/", F.col("url"), 9)
    path_of = F.when(slash > 0, F.substr("url", slash)).otherwise("/cur")
    by_url = corpus.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/mail"), path_of).alias("maildir_path")
    )
    paths = corpus.occurrences(spark, sf_dir).select("maildir_path").unionByName(by_url)
    path = F.col("maildir_path")
    return paths.select(path.alias("path"), headers.folder_of(path, "/mail").alias("folder"))


@query(
    "download_name",
    rf"""WITH {TYPED},
named AS (SELECT sha256, arg_min(filename, maildir_path) AS filename FROM typed
  WHERE filename IS NOT NULL GROUP BY sha256),
files AS (SELECT DISTINCT sha256, sniffed_type, sniffed_ext FROM typed),
joined AS (SELECT f.*, n.filename,
  coalesce(nullif(n.filename, ''), left(sha256, 12) || '.' || coalesce(sniffed_ext, 'bin')) AS name
  FROM files f LEFT JOIN named n USING (sha256)),
safe AS (SELECT *, left(regexp_replace(name, '["\\/\n\x{{200b}}\x{{a0}}]', '', 'g'), 120) AS s
  FROM joined)
SELECT sha256, coalesce(nullif(s, ''), left(sha256, 12)) AS download_name,
  coalesce(sniffed_type LIKE 'image/%' OR sniffed_type IN
    ('application/pdf', 'text/plain', 'application/xml'), false) AS inline_safe,
  upper(left(coalesce(sniffed_ext, nullif(string_split(filename, '.')[-1], ''), 'bin'), 5)) AS label
FROM safe""",
)
def download_name(spark, sf_dir):
    view = typed_occurrences(spark, sf_dir)
    named = reports.names_by_digest(view)
    files = dedup.blob_rows(view).select("sha256", "sniffed_type", "sniffed_ext")
    ext, name = F.col("sniffed_ext"), F.col("filename")
    return files.join(named, "sha256", "left").select(
        "sha256",
        names.download_name(name, F.col("sha256"), ext).alias("download_name"),
        names.inline_safe(F.col("sniffed_type")).alias("inline_safe"),
        names.extension_label(ext, name).alias("label"),
    )
