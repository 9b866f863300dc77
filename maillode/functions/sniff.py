"""File type from leading bytes, as one CASE over a BINARY column.

What a part claims to be is kept apart from what its bytes are. The order of
the rules is part of their meaning: the first one that fits wins, and nothing
is guessed when none does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes looked at, for prefixes and text, and inside containers.
HEAD_BYTES = 512
CONTAINER_BYTES = 4096

# First four bytes of a ZIP container.
ZIP_HEADS = ("504B0304", "504B0506", "504B0708")

# What inside a ZIP names its kind, type, extension.
ZIP_MARKERS = (
    (
        "mimetypeapplication/vnd.oasis.opendocument",
        "application/vnd.oasis.opendocument",
        "odf",
    ),
    (
        "word/",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "docx",
    ),
    ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    (
        "ppt/",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "pptx",
    ),
)

# Bytes 5-12 of an MPEG-4 file.
MP4_BRANDS = ("ftypisom", "ftypmp42", "ftypM4A ", "ftypqt  ")

# Bytes 9-12 of a RIFF file, type, extension.
RIFF_FORMS = (
    ("WAVE", "audio/wav", "wav"),
    ("WEBP", "image/webp", "webp"),
    ("AVI ", "video/x-msvideo", "avi"),
)

# Leading bytes in hexadecimal, type, extension.
PREFIXES = (
    ("255044462D", "application/pdf", "pdf"),
    ("89504E470D0A1A0A", "image/png", "png"),
    ("FFD8FF", "image/jpeg", "jpg"),
    ("474946383761", "image/gif", "gif"),
    ("474946383961", "image/gif", "gif"),
    ("49492A00", "image/tiff", "tif"),
    ("4D4D002A", "image/tiff", "tif"),
    ("424D", "image/bmp", "bmp"),
    ("00000100", "image/vnd.microsoft.icon", "ico"),
    ("25215053", "application/postscript", "ps"),
    ("1F8B", "application/gzip", "gz"),
    ("425A68", "application/x-bzip2", "bz2"),
    ("377ABCAF271C", "application/x-7z-compressed", "7z"),
    ("526172211A07", "application/vnd.rar", "rar"),
    ("D0CF11E0", "application/x-ole-storage", "doc"),
    ("7B5C727466", "application/rtf", "rtf"),
    ("4F676753", "audio/ogg", "ogg"),
    ("494433", "audio/mpeg", "mp3"),
    ("664C6143", "audio/flac", "flac"),
    ("0001000000", "font/ttf", "ttf"),
    ("4F54544F", "font/otf", "otf"),
    ("774F4646", "font/woff", "woff"),
    ("7F454C46", "application/x-executable", "elf"),
    ("CAFEBABE", "application/java-vm", "class"),
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3", "sqlite"),
)


def sniff(column: str) -> Column:
    """Struct (sniffed_type, sniffed_ext) of a BINARY column; both NULL for bytes no rule names.

    The column may hold the whole file or any prefix of at least 4,096 bytes.
    The rules are handed to Spark as one SQL expression, which it parses at once;
    as many Column calls would take longer than the query.
    """
    return F.expr(sniff_sql(column))


def sniff_sql(data: str) -> str:
    head = f"substring({data}, 1, {HEAD_BYTES})"
    latin = f"decode({head}, 'ISO-8859-1')"
    is_zip = f"substring({data}, 1, 4) IN ({', '.join(map(_hex, ZIP_HEADS))})"
    window = f"substring({data}, 1, {CONTAINER_BYTES})"
    rules = [
        *(
            (f"{is_zip} AND contains({window}, {_ascii(marker)})", mime, ext)
            for marker, mime, ext in ZIP_MARKERS
        ),
        (is_zip, "application/zip", "zip"),
        (
            f"substring({data}, 5, 8) IN ({', '.join(map(_ascii, MP4_BRANDS))})",
            "video/mp4",
            "mp4",
        ),
        *(
            (
                f"startswith({data}, {_ascii('RIFF')})"
                f" AND substring({data}, 9, 4) = {_ascii(form)}",
                mime,
                ext,
            )
            for form, mime, ext in RIFF_FORMS
        ),
        *((f"startswith({data}, {_hex(prefix)})", mime, ext) for prefix, mime, ext in PREFIXES),
        (rf"{latin} RLIKE r'(?i)^[\t-\r ]*<\?xml'", "application/xml", "xml"),
        (rf"{latin} RLIKE r'(?i)^[\t-\r ]*<(html|!doct)'", "text/html", "html"),
        (f"is_valid_utf8({head})", "text/plain", "txt"),
    ]
    whens = " ".join(f"WHEN {test} THEN {_kind(repr(m), repr(e))}" for test, m, e in rules)
    return f"CASE {whens} ELSE {_kind('CAST(NULL AS STRING)', 'CAST(NULL AS STRING)')} END"


def _kind(mime: str, ext: str) -> str:
    return f"named_struct('sniffed_type', {mime}, 'sniffed_ext', {ext})"


def _hex(hexa: str) -> str:
    return f"X'{hexa}'"


def _ascii(text: str) -> str:
    return _hex(text.encode("ascii").hex())
