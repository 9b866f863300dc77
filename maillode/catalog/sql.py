"""Pieces of reference SQL (DuckDB): the adapters restated as closed forms."""

from __future__ import annotations

FOLDER_LIST = (
    "['INBOX', '.Gesendet', '.Archives.2007', '.Junk', '.reports.dmarc',"
    " '.Sent Messages', '.Projects.2013.Inbox', '.Spam']"
)
NOISE = "('.reports.dmarc', '.Junk', '.Spam', '.Trash', '.Deleted Messages')"
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
PAGE = 120
SPACES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def fold(column: str) -> str:
    return f"translate({column}, {FOLD})"


# Fixed values, stated here a second time so that the reference SQL depends on nothing that it
# is to check: hexadecimal leading bytes, type, extension.
LEADING_BYTES = """
255044462D application/pdf pdf
89504E470D0A1A0A image/png png
FFD8FF image/jpeg jpg
474946383761 image/gif gif
474946383961 image/gif gif
49492A00 image/tiff tif
4D4D002A image/tiff tif
424D image/bmp bmp
00000100 image/vnd.microsoft.icon ico
25215053 application/postscript ps
1F8B application/gzip gz
425A68 application/x-bzip2 bz2
377ABCAF271C application/x-7z-compressed 7z
526172211A07 application/vnd.rar rar
D0CF11E0 application/x-ole-storage doc
7B5C727466 application/rtf rtf
4F676753 audio/ogg ogg
494433 audio/mpeg mp3
664C6143 audio/flac flac
0001000000 font/ttf ttf
4F54544F font/otf otf
774F4646 font/woff woff
7F454C46 application/x-executable elf
CAFEBABE application/java-vm class
53514C69746520666F726D6174203300 application/vnd.sqlite3 sqlite
"""
OFFICE = "application/vnd.openxmlformats-officedocument"


def sniff_case(blob: str, result: int) -> str:
    """Type (1) or extension (2) of a blob, by hexadecimal comparison."""
    head = f"hex({blob}[1:16])"
    window = f"hex({blob}[1:4096])"
    text = f"hex({blob}[1:512])"
    is_zip = f"substr({head}, 1, 8) IN ('504B0304', '504B0506', '504B0708')"
    odf = "application/vnd.oasis.opendocument"
    inside = [
        ("mimetype" + odf, odf, "odf"),
        ("word/", OFFICE + ".wordprocessingml.document", "docx"),
        ("xl/", OFFICE + ".spreadsheetml.sheet", "xlsx"),
        ("ppt/", OFFICE + ".presentationml.presentation", "pptx"),
    ]
    rules = [
        (f"{is_zip} AND contains({window}, '{_hex(marker)}')", mime, ext)
        for marker, mime, ext in inside
    ]
    rules.append((is_zip, "application/zip", "zip"))
    brands = ", ".join(f"'{_hex('ftyp' + b)}'" for b in ("isom", "mp42", "M4A ", "qt  "))
    rules.append((f"substr({head}, 9, 16) IN ({brands})", "video/mp4", "mp4"))
    rules += [
        (f"{head} LIKE '52494646________{_hex(form)}%'", mime, ext)
        for form, mime, ext in (
            ("WAVE", "audio/wav", "wav"),
            ("WEBP", "image/webp", "webp"),
            ("AVI ", "video/x-msvideo", "avi"),
        )
    ]
    for line in LEADING_BYTES.split("\n")[1:-1]:
        prefix, mime, ext = line.split()
        rules.append((f"starts_with({head}, '{prefix}')", mime, ext))
    blank = "^(09|0A|0B|0C|0D|20)*"
    rules += [
        (f"regexp_matches({text}, '{blank}3C3F[57]8[46]D[46]C')", "application/xml", "xml"),
        (
            f"regexp_matches({text}, '{blank}3C([46]8[57]4[46]D[46]C|21[46]4[46]F[46]3[57]4)')",
            "text/html",
            "html",
        ),
        (f"TRY(decode({blob}[1:512])) IS NOT NULL", "text/plain", "txt"),
    ]
    whens = " ".join(f"WHEN {rule[0]} THEN '{rule[result]}'" for rule in rules)
    return f"CASE {whens} END"


def _hex(text: str) -> str:
    return text.encode("ascii").hex().upper()


OCC = f"""
docs AS (
  SELECT doc_id AS i, CAST(substr(source, 4) AS BIGINT) AS n, text, encode(text) AS b
  FROM documents
),
occ AS (
  SELECT
    '/mail/' || CASE WHEN n % 8 = 0 THEN '' ELSE {FOLDER_LIST}[n % 8 + 1] || '/' END
      || 'cur/d' || i AS maildir_path,
    '2' AS part_path,
    sha256(text) AS sha256,
    CASE WHEN i % 7 = 0 THEN NULL
         WHEN i % 2 = 0 THEN 'Doc_' || (i % 13) || '.TXT'
         ELSE 'doc_' || (i % 13) || '.txt' END AS filename,
    CASE i % 4 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'text/plain'
               WHEN 2 THEN 'image/png' END AS mime_declared,
    false AS decode_failed,
    CAST(octet_length(b) AS BIGINT) AS size,
    {sniff_case("b", 1)} AS sniffed_type,
    {sniff_case("b", 2)} AS sniffed_ext,
    {FOLDER_LIST}[n % 8 + 1] AS folder,
    ['out', 'in', 'unknown'][i % 3 + 1] AS direction,
    text AS subject,
    'Person ' || (i % 11) || ' <p' || (i % 11) || '@mail' || (i % 5) || '.example.com>' AS from_raw,
    CASE WHEN i % 3 = 0 THEN 'someone@elsewhere.example' ELSE 'me@example.com' END AS to_raw,
    CASE WHEN i % 10 <> 0 THEN (2002 + i % 12) || '-0' || (1 + i % 9) || '-1' || (i % 10)
         || 'T09:15:00+01:00' END AS date_parsed,
    CASE WHEN i % 10 <> 0 THEN CAST(2002 + i % 12 AS VARCHAR) END AS year,
    i
  FROM docs
)"""

LISTED = (
    "maildir_path, part_path, sha256, filename, mime_declared, sniffed_type, sniffed_ext, size,"
    " folder, direction, subject, from_raw, to_raw, decode_failed, date_parsed"
)
EARLIEST = "date_parsed IS NULL, date_parsed, maildir_path, part_path"


def collapsed(rows: str) -> str:
    """One row per digest of a relation: the earliest occurrence."""
    return (
        f"SELECT {LISTED} FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY sha256 ORDER BY {EARLIEST}) AS rn FROM ({rows})) WHERE rn = 1"
    )


UP = "maildir_path, part_path"
DOWN = "maildir_path DESC, part_path DESC"
ORDERS = {
    "date": f"date_parsed DESC NULLS LAST, {DOWN}",
    "oldest": f"date_parsed ASC NULLS FIRST, {UP}",
    "size": f"size DESC, sha256, {UP}",
    "name": f"{fold('filename')} ASC NULLS FIRST, sha256, {UP}",
    "dupes": f"copies DESC, sha256, {UP}",
}


def page(rows: str, sort: str = "date", number: int = 0) -> str:
    """A page of a listing over ``occ``, with copies and positions."""
    low = number * PAGE
    return f"""
WITH {OCC},
copies AS (SELECT sha256, count(*) AS copies FROM occ GROUP BY sha256),
rows_ AS (SELECT r.*, c.copies FROM ({rows}) r JOIN copies c USING (sha256)),
ranked AS (SELECT {LISTED}, copies, row_number() OVER (ORDER BY {ORDERS[sort]}) AS pos FROM rows_)
SELECT * FROM ranked WHERE pos > {low} AND pos <= {low + PAGE}"""
