"""Text repair as Column expressions: whitespace, case, character sets, markup."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Python's str.isspace() accepts, which is what
# str.strip() removes and what \s matches in a Python pattern.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

# Bytes cp1252 leaves undefined; text holding one of them is latin-1.
CP1252_HOLES = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in CP1252_HOLES]
_CP1252_FROM = "".join(map(chr, _CP1252_BYTES))
_CP1252_TO = bytes(_CP1252_BYTES).decode("cp1252")

# What markup becomes, in order. (?U) gives \b Python's meaning, and
# (?-u) the back-reference, which tells a long s from an s where the words do not.
MARKUP = (
    (r"(?isU)<(script|style)\b.*?</(?-u)\1>", " "),
    (rf"(?iU)<{SPACE_CLASS}*(br|/p|/div|/tr|/h[1-6])\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)

# How much of a text file is shown, and how much of a body.
TEXT_VIEW_BYTES = 262_144
BODY_CHARS = 200_000
NO_BODY = "[nothing to read in this message]"

_LIKE_ESCAPE = "\x01"


def strip(col: Column) -> Column:
    """Trim as Python does, in linear time on any run of blanks."""
    return F.btrim(col, F.lit(PY_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def clean(col: Column) -> Column:
    """Drop NULs, trim, squeeze each run of whitespace to one space, '' to NULL."""
    # Characters past the end of the replacement string are dropped, here NUL.
    spaced = F.translate(col, PY_SPACE + "\x00", " " * len(PY_SPACE))
    return blank_to_null(F.trim(F.regexp_replace(spaced, " {2,}", " ")))


def ascii_fold(col: Column) -> Column:
    """Lower A-Z only, leaving every other letter as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def like_ascii(col: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case and treats a backslash as an ordinary character."""
    folded = pattern.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    folded = folded.replace(_LIKE_ESCAPE, _LIKE_ESCAPE * 2)
    return F.like(ascii_fold(col), F.lit(folded), F.lit(_LIKE_ESCAPE))


def charset_of(raw: Column) -> Column:
    """Which step of the utf-8, cp1252, latin-1 ladder accepts these bytes."""
    return (
        F.when(raw.isNull(), F.lit(None))
        .when(F.is_valid_utf8(raw), "utf-8")
        .when(_has_cp1252_hole(_latin1(raw)), "latin-1")
        .otherwise("cp1252")
    )


def decode_ladder(raw: Column) -> Column:
    """Text of bytes of unknown vintage, by the first character set that fits."""
    latin = _latin1(raw)
    return (
        F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8"))
        .when(_has_cp1252_hole(latin), latin)
        .otherwise(F.translate(latin, _CP1252_FROM, _CP1252_TO))
    )


def _latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def _has_cp1252_hole(latin: Column) -> Column:
    return latin.rlike("[" + "".join(f"\\x{b:02x}" for b in CP1252_HOLES) + "]")


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape_entities(col: Column) -> Column:
    """Resolve HTML entities; only rows holding an ampersand carry text to Python."""
    with_entity = F.when(F.contains(col, F.lit("&")), col)
    return F.coalesce(_unescape(with_entity), col)


def strip_markup(col: Column) -> Column:
    """Remove script, style and tags; closing blocks become line breaks."""
    for pattern, replacement in MARKUP:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def html_to_text(col: Column) -> Column:
    """Readable text of an HTML string."""
    text = unescape_entities(strip_markup(col))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def text_view(
    content: Column, sniffed_type: Column, view_bytes: int = TEXT_VIEW_BYTES
) -> Column:
    """Struct (text, charset, truncated) for showing a stored text file.

    The cut comes before the decoding, so a character split at the limit moves
    the file down the ladder.
    """
    head = F.substring(content, 1, view_bytes)
    text = decode_ladder(head)
    is_html = sniffed_type.eqNullSafe("text/html")
    shown = F.when(is_html, html_to_text(F.when(is_html, text))).otherwise(text)
    return F.struct(
        shown.alias("text"),
        charset_of(head).alias("charset"),
        (F.octet_length(content) > view_bytes).alias("truncated"),
    )


def body_text(texts: Column) -> Column:
    """Body of a message from its array of (content_type, text): plain before HTML."""

    def joined(kind: str) -> Column:
        wanted = F.filter(texts, lambda t: t["content_type"] == kind)
        return F.when(
            F.size(wanted) > 0,
            F.array_join(F.transform(wanted, lambda t: t["text"]), "\n\n"),
        )

    plain = joined("text/plain")
    rich = F.when(plain.isNull(), joined("text/html"))
    return F.coalesce(strip(plain), html_to_text(rich), F.lit(NO_BODY))


def cut_body(body: Column, chars: int = BODY_CHARS) -> tuple[Column, Column]:
    """The body as shown and whether it was cut."""
    return F.substring(body, 1, chars), F.length(body) > chars
