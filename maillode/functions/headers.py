"""Folder, ownership, direction and date, derived with Column expressions."""

from __future__ import annotations

import email.charset
import encodings
import pkgutil
import re
from collections.abc import Callable, Mapping, Sequence
from email.header import decode_header, make_header
from email.utils import parsedate_to_datetime
from encodings.aliases import aliases
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import PY_SPACE, blank_to_null, strip

# Words that mark a folder of sent mail, matched whole in any case.
SENT_WORDS = ("sent", "gesendet", "ausgang", "outbox", "postausgang")

# Epoch seconds before the first dot of a file name, the year
# segment of a folder name, and the years taken to be real.
EPOCH_PREFIX = r"^(\d{9,11})\."
FOLDER_YEAR = r"\.(19[89]\d|20[0-4]\d)(?:\.|\z)"
YEAR_AFTER, YEAR_BEFORE = 1980, 2100

# Where lines end and what counts as blank in a header of ASCII letters, and beside
# which letters an encoded word needs no space.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e]"
BLANK = r"[\t-\r\x1c-\x20]"
NO_SPACE_AT = r"[\t-\r\x1c-\x20()\\]"

# Up to the first ?= of its line, written so that no step is taken back in a long word.
_IN_WORD = r"[^?\n\r]*+"
ENCODED_WORD = rf"=\?[^?]*+\?[qQbB]\?{_IN_WORD}(?:\?(?!=){_IN_WORD})*+\?="
SET_OF_WORD = r"\A=\?([^?]*+)\?"
BLANK_WORD = rf"{SET_OF_WORD}[qQbB]\?{BLANK}*+\?=\z"
# Encoded words that Column expressions can decode: the letter each character set goes by, and
# what may stand in a word.
NATIVE_SETS = {"u": "utf-8", "l": "iso-8859-1"}
_QUARTET = "[A-Za-z0-9+/]"
NATIVE_WORD = (
    rf"\A=\?(?i:{'|'.join(NATIVE_SETS.values())})\?(?:[qQ]\?[\t -~]*+\z"
    rf"|[bB]\?(?:{_QUARTET}{{4}})*+(?:{_QUARTET}{{2}}(?:==)?|{_QUARTET}{{3}}=?)?\?=\z)"
)


def rfc2047(raw: str | None) -> str | None:
    """Decode encoded words; text that will not decode is returned as it came."""
    if raw is None:
        return None
    try:
        text = str(make_header(decode_header(raw)))
    except Exception:
        text = raw
    return text.strip() or None


def rfc5322_iso(raw: str | None) -> str | None:
    """ISO text of a date header in its sender's own offset, NULL for rubbish."""
    try:
        return parsedate_to_datetime(raw).isoformat() if raw else None
    except Exception:
        return None


@F.arrow_udf(StringType())
def _decoded(raw: pa.Array) -> pa.Array:
    """:func:`rfc2047`, "" where nothing is left and NULL where a header is but stripped.

    Headers leave Arrow one at a time, and those that don't change aren't sent back, so that a
    worker holds a batch hardly more than once.
    """

    def changed(header: str | None) -> str | None:
        text = rfc2047(header) or ""
        return None if header is None or text == header.strip() else text

    return pa.array((changed(header.as_py()) for header in raw), pa.string())


@cache
def known_sets() -> tuple[str, ...]:
    """The names that Python may know a character set by, in small letters and digits alone.

    Python takes some other signs in a name for one another; without any, two names that it
    takes for the same are the same here as well.
    """
    modules = (module.name for module in pkgutil.iter_modules(encodings.__path__))
    mail = email.charset
    codecs = (name or "" for name in mail.CODEC_MAP.values())
    names = {
        "", mail.UNKNOWN8BIT, *aliases, *aliases.values(), *modules, *codecs,
        *mail.ALIASES, *mail.ALIASES.values(), *mail.CHARSETS, *mail.CODEC_MAP,
    }
    return tuple(sorted({re.sub("[^a-z0-9]", "", name.lower()) for name in names}))


def decode_words(raw: Column) -> Column:
    """A header's text with its encoded words decoded, NULL where nothing is left of it.

    What :func:`is_native` accepts is decoded by :func:`native_words`, and what has a word in no
    known character set stays as it is; only headers with other known sets, stray letters or
    broken base64 carry their text to Python.
    """
    marked = F.contains(raw, F.lit("=?"))
    plain = _let(strip(raw), blank_to_null)
    rare = _decoded(F.when(marked & (_word_state(raw) == "rare"), raw))
    stay = {state: plain for state in ("plain", "unknown", "rare")}
    here = _word_state(raw, stay | {"native": native_words(raw)})
    return F.when(marked, _let(F.coalesce(rare, here), blank_to_null)).otherwise(plain)


def _word_state(raw: Column, results: Mapping[str, Column] | None = None) -> Column:
    """Whether a header has encoded words, and whether Column expressions can decode it.

    The result is one of plain, native, unknown and rare, or what ``results`` has for it.
    """
    results = results or {s: F.lit(s) for s in ("plain", "native", "unknown", "rare")}
    words = F.regexp_extract_all(raw, F.lit(ENCODED_WORD), 0)
    ascii_only = F.length(raw) == F.octet_length(raw)
    return _let(
        words,
        lambda found: F.when(F.size(found) == 0, results["plain"])
        .when(ascii_only & F.forall(found, lambda w: w.rlike(NATIVE_WORD)), results["native"])
        .when(ascii_only & _has_unknown_set(raw), results["unknown"])
        .otherwise(results["rare"]),
    )


def _has_unknown_set(raw: Column) -> Column:
    """Whether a word of an ASCII header is in a set that Python surely doesn't know.

    One such word keeps the whole header from being decoded. Blank words don't count, because they
    may be dropped between others.
    """

    def unknown(word: Column) -> Column:
        name = F.lower(F.regexp_extract(word, SET_OF_WORD, 1))
        return ~F.regexp_replace(name, "[^a-z0-9]", "").isin(*known_sets()) & ~word.rlike(BLANK_WORD)

    words = F.transform(
        F.split(raw, LINE_END), lambda line: F.regexp_extract_all(line, F.lit(ENCODED_WORD), 0)
    )
    return F.exists(F.flatten(words), unknown)


def is_native(raw: Column) -> Column:
    """Whether a header has encoded words, all well-formed and in utf-8 or latin-1, among ASCII."""
    return _word_state(raw) == "native"


def native_words(raw: Column) -> Column:
    """:func:`rfc2047` for headers that :func:`is_native` accepts, as Column expressions.

    Neighbouring words in one character set are decoded as one, so that a letter may be split
    between them; blanks between two words are dropped. Each piece of the header is written as a
    letter for its kind and its bytes in hex, so that neighbours of a kind are found by a pattern.
    """
    lines = F.transform(F.split(raw, LINE_END), lambda line: F.ltrim(line, F.lit(PY_SPACE)))
    pieces = F.flatten(F.transform(lines, _pieces))
    coded = _let(pieces, lambda all_: F.array_join(F.transform(_without_gaps(all_), _coded), ""))
    kinds = "|".join(f"(?:{kind}[0-9A-F]*+)++" for kind in ("t", *NATIVE_SETS))
    runs = F.transform(F.regexp_extract_all(coded, F.lit(kinds), 0), _run_text)
    joined = _let(
        runs,
        lambda texts: F.when(
            F.exists(texts, lambda t: t["text"].isNull()), F.lit(None).cast("string")
        ).otherwise(F.array_join(F.transform(texts, lambda t, i: _spaced(t, i, F.size(texts))), "")),
    )
    return _let(strip(F.coalesce(joined, raw)), blank_to_null)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(line: Column) -> Column:
    """A line's texts and encoded words in turn, as (word, body)."""
    texts = F.split(line, ENCODED_WORD)
    words = F.regexp_extract_all(line, F.lit(ENCODED_WORD), 0)

    def pair(text: Column, word: Column) -> Column:
        kind = F.lit("t")
        head = F.lit(0)
        start = F.lower(F.substring(word, 1, max(map(len, NATIVE_SETS.values())) + 3))
        for letter, name in NATIVE_SETS.items():
            found = F.startswith(start, F.lit(f"=?{name}?"))
            kind = F.when(found, letter).otherwise(kind)
            head = F.when(found, len(name) + 5).otherwise(head)
        encoding = F.lower(F.substring(word, head - 1, F.lit(1)))
        body = F.substring(word, head + 1, F.length(word) - head - 2)
        plain = F.struct(
            F.lit("t").alias("kind"), F.lit(None).cast("string").alias("encoding"), text.alias("body")
        )
        return F.array(
            plain, F.struct(kind.alias("kind"), encoding.alias("encoding"), body.alias("body"))
        )

    both = F.flatten(F.zip_with(texts, words, pair))
    return F.filter(both, lambda p: F.when(p["kind"] == "t", p["body"] != "").otherwise(True))


def _without_gaps(pieces: Column) -> Column:
    """Without blank pieces that stand between two encoded words."""

    def kept(piece: Column, i: Column) -> Column:
        around = [F.get(pieces, i + step)["kind"] for step in (-1, 1)]
        between = (F.coalesce(around[0], F.lit("t")) != "t") & (
            F.coalesce(around[1], F.lit("t")) != "t"
        )
        return ~(between & piece["body"].rlike(rf"\A{BLANK}+\z"))

    return F.filter(pieces, kept)


def _coded(piece: Column) -> Column:
    body = piece["body"]
    missing = F.pmod(-F.length(body), F.lit(4))
    base64 = F.hex(F.unbase64(F.concat(body, F.repeat(F.lit("="), missing))))
    tokens = F.regexp_extract_all(
        F.replace(body, F.lit("_"), F.lit(" ")),
        F.lit("(?:=[0-9A-Fa-f]{2})++|[^=]++|="), 0,
    )
    quoted = F.transform(
        tokens,
        lambda t: F.when(t.rlike("^=[0-9A-Fa-f]"), F.upper(F.replace(t, F.lit("="), F.lit(""))))
        .otherwise(F.hex(t)),
    )
    return F.concat(
        piece["kind"],
        F.when(piece["kind"] == "t", F.hex(body))
        .when(piece["encoding"] == "b", base64)
        .otherwise(F.array_join(quoted, "")),
    )


def _run_text(run: Column) -> Column:
    """(kind, text) of neighbours of one kind; texts are set apart by a space, words aren't."""
    kind = F.substring(run, 1, 1)
    rest = F.substring(run, F.lit(2), F.length(run))
    raw = F.unhex(F.replace(rest, kind, F.when(kind == "t", "20").otherwise("")))
    text = F.when(kind == "l", F.decode(raw, "ISO-8859-1")).when(
        F.is_valid_utf8(raw), F.decode(raw, "UTF-8")
    )
    return F.struct(kind.alias("kind"), text.alias("text"))


def _spaced(run: Column, i: Column, n: Column) -> Column:
    """A text keeps apart from the words beside it, unless a blank or a bracket does so."""
    text = run["text"]
    apart = F.lit(" ")
    before = F.when((i > 0) & ~text.rlike(rf"\A{NO_SPACE_AT}"), apart).otherwise("")
    after = F.when((i < n - 1) & ~text.rlike(rf"{NO_SPACE_AT}\z"), apart).otherwise("")
    return F.when(run["kind"] == "t", F.concat(before, text, after)).otherwise(text)


def folder_of(path: Column, root: str) -> Column:
    """First directory under the root, or INBOX for the root's own cur and new."""
    below = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30), "/")
    return F.when(F.size(below) >= 3, F.element_at(below, 1)).otherwise("INBOX")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_sent_folder(folder: Column) -> Column:
    """Only the last dotted segment counts: .Sent.2013 is not a sent folder."""
    last = F.element_at(F.split(folder, r"\."), -1)
    return last.rlike(rf"(?iU)\b({'|'.join(SENT_WORDS)})\b")


def is_mine(addr: Column, me: Sequence[str]) -> Column:
    """Suffix test against addresses or @domains; with no list nothing is mine."""
    hits = [F.endswith(addr, F.lit(m.lower())) for m in me]
    any_hit = reduce(lambda a, b: a | b, hits, F.lit(False))
    return F.coalesce((addr != "") & any_hit, F.lit(False))


def direction(from_addr: Column, recipients: Column, folder: Column, me: Sequence[str]) -> Column:
    """Addresses decide first, the folder name only when none of them is ours."""
    to_me = F.exists(F.coalesce(recipients, F.array()), lambda a: is_mine(a, me))
    return (
        F.when(is_mine(from_addr, me), "out")
        .when(to_me, "in")
        .when(is_sent_folder(folder), "out")
        .when(from_addr.isNotNull(), "in")
        .otherwise("unknown")
    )


def dated(date_header: Column, path: Column, folder: Column) -> Column:
    """Struct (date_parsed, date_source): header, then file name, then folder year."""
    by_header = F.when(_real_year(date_header), date_header)
    digits = blank_regex(file_name(path), EPOCH_PREFIX)
    epoch = F.timestamp_add(
        "SECOND", digits.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )
    # TIMESTAMP_NTZ renders without regard to the session's time zone.
    iso = F.concat(F.replace(epoch.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    by_name = F.when(_real_year(iso), iso)
    by_folder = F.concat(blank_regex(folder, FOLDER_YEAR), F.lit("-01-01T00:00:00+00:00"))
    return F.struct(
        F.coalesce(by_header, by_name, by_folder).alias("date_parsed"),
        F.when(by_header.isNotNull(), "header")
        .when(by_name.isNotNull(), "filename")
        .when(by_folder.isNotNull(), "folder")
        .otherwise("none")
        .alias("date_source"),
    )


def blank_regex(col: Column, pattern: str) -> Column:
    """First group of the pattern, NULL where it does not match."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def year_of(iso: Column) -> Column:
    return F.substring(iso, 1, 4)


def _real_year(iso: Column) -> Column:
    year = year_of(iso)
    return (year > str(YEAR_AFTER)) & (year < str(YEAR_BEFORE))
