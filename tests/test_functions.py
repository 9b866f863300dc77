"""Column functions: literal in, literal out."""

from __future__ import annotations

import base64
import encodings.aliases
import random

import pytest
from pyspark.sql import functions as F

from maillode.functions import headers, names, sniff, text

from .conftest import PLAN, SCORE, SOUND

ZIP = b"PK\x03\x04" + b"\x00" * 26


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    out = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in out]


SNIFFED = [
    (SCORE, "zip"),
    (SOUND, "wav"),
    (PLAN, "sqlite"),
    (b"GIF89a!", "gif"),
    (b"\x89PNG\r\n\x1a\n.", "png"),
    (b"%PDF-2.0", "pdf"),
    (ZIP + b"word/document.xml", "docx"),
    (ZIP + b"xl/workbook.xml", "xlsx"),
    (ZIP + b"ppt/slides", "pptx"),
    (ZIP + b"mimetypeapplication/vnd.oasis.opendocument.text word/", "odf"),
    (ZIP + b"META-INF/", "zip"),
    (ZIP + b"x" * 4096 + b"word/", "zip"),
    (b"PK\x05\x06", "zip"),
    (b"PK\x01\x02\xff", None),
    (b"\x00\x00\x00\x18ftypisom\x00", "mp4"),
    (b"\x00\x00\x00\x18ftypmp42\xff", "mp4"),
    (b"\x00\x00\x00\x18ftypM4A \xff", "mp4"),
    (b"\x00\x00\x00\x18ftypqt  \xff", "mp4"),
    (b"\x00\x00\x00\x18ftypheic\xff", None),
    (b"RIFF\x00\x00\x00\x00WAVEfmt ", "wav"),
    (b"RIFF\x00\x00\x00\x00WEBPVP8 ", "webp"),
    (b"RIFF\x00\x00\x00\x00AVI LIST", "avi"),
    (b"RIFF\x00\x00\x00\x00ACON\xff", None),
    (b"BMW is not a bitmap", "bmp"),
    (b" \t\r\n\x0b\x0c<?XmL version", "xml"),
    (b"\n<HTML>", "html"),
    (b"<!DocType html>", "html"),
    (b"<!do", "txt"),
    (b"", "txt"),
    (b"a\x00b", "txt"),
    ("Grüße".encode(), "txt"),
    ("Grüße".encode("cp1252"), None),
    (b"\xde\xad\xbe\xef", None),
    (b"x" * 511 + "ü".encode(), None),
    (b"x" * 510 + "ü".encode() + b"\xff", "txt"),
    (None, None),
]


def test_sniff_literals(spark):
    got = apply(spark, [d for d, _ in SNIFFED], lambda c: sniff.sniff("v"), "binary")
    assert [r.sniffed_ext for r in got] == [ext for _, ext in SNIFFED]


def test_every_prefix_names_its_type(spark):
    data = [bytes.fromhex(p) + b"\xff\x00" for p, _, _ in sniff.PREFIXES]
    got = apply(spark, data, lambda c: sniff.sniff("v"), "binary")
    assert [(r.sniffed_type, r.sniffed_ext) for r in got] == [(m, e) for _, m, e in sniff.PREFIXES]


def ladder(raw: bytes) -> tuple[str, str]:
    def fits(encoding):
        return raw.decode(encoding, "ignore").encode(encoding) == raw

    found = next(e for e in ("utf-8", "cp1252", "latin-1") if fits(e))
    return raw.decode(found), found


def test_charset_ladder_equals_the_python_decoders(spark):
    rng = random.Random(7)
    raws = [bytes([b]) for b in range(256)]
    raws += [bytes(rng.choices(range(256), k=rng.randint(0, 6))) for _ in range(400)]
    raws += ["Süßholz à la crème".encode("cp1252"), b"\x81\x8d\x8f\x90\x9d", "‘tea’ — 3 €".encode("cp1252")]
    got = apply(
        spark, raws, lambda c: F.struct(text.decode_ladder(c), text.charset_of(c)), "binary"
    )
    assert [tuple(r) for r in got] == [ladder(raw) for raw in raws]


SPACED = ["a\x00b   c\n\nd", "   ", "", None, "\x1c a 　b\x85 ", "​x ", "\x00", "a᠎b"]


def test_clean_equals_the_python_rules(spark):
    def expected(value):
        if value is None:
            return None
        return " ".join(value.replace("\x00", "").split()) or None

    assert apply(spark, SPACED, text.clean) == [expected(v) for v in SPACED]


def test_whitespace_set_is_pythons():
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(text.PY_SPACE) == spaces


PAGES = [
    ("<p>a &amp; b</p><br>c", "a & b\n\nc"),
    ("<style>p{color:red}</style><script>evil()</script><p>Kept</p>", "Kept"),
    ("<SCRIPT type='x'>a</Script >b</SCRIPT>c<scripty>d</scripty>", "cd"),
    ("x<br/>\n\n\n\n<div>y</div>\n\n\n&nbsp;&#228;&auml&notit;", "x\n\ny\n\n\xa0\u00e4\u00e4\u00acit;"),
    ("unclosed <script> stays", "unclosed  stays"),
    ("1 < 2 > 3 <> <\n/p class='a'>z</H1>q</h7>", "1  3 <> \nz\nq"),
    ("\u3000 trim me \x1c", "trim me"),
    ("<\u2003br>a<\u017fcript>b</script>c", "abc"),
    ("a<\u017fcript>b</\u017fCRIPT>c", "a c"),
    ("", ""),
]


def test_html_to_text(spark):
    assert apply(spark, [p for p, _ in PAGES], text.html_to_text) == [t for _, t in PAGES]


def test_text_view_cuts_before_decoding(spark):
    limit = text.TEXT_VIEW_BYTES
    whole = b"x" * (limit - 1)
    raws = [whole + "ü".encode(), whole + b"y", b"<p>a</p>"]
    got = apply(spark, raws, lambda c: text.text_view(c, F.lit("text/plain")), "binary")
    assert [(r.charset, r.truncated) for r in got] == [
        ("cp1252", True),
        ("utf-8", False),
        ("utf-8", False),
    ]
    as_html = apply(spark, raws[2:], lambda c: text.text_view(c, F.lit("text/html")), "binary")
    assert as_html[0].text == "a"


def test_like_folds_ascii_only_and_knows_no_escape(spark):
    values = ["A\\B", "a\\b", "Ä", "ä", "100%", "x\x01y"]
    assert apply(spark, values, lambda c: text.like_ascii(c, "a\\b"))[:2] == [True, True]
    assert apply(spark, values, lambda c: text.like_ascii(c, "ä"))[2:4] == [False, True]
    assert apply(spark, values, lambda c: text.like_ascii(c, "X\x01Y"))[5]
    assert apply(spark, ["Doc_1.TXT"], lambda c: text.like_ascii(c, "%oc_1.t%")) == [True]


def test_header_decoding(spark):
    cases = {
        "=?utf-8?q?caf=C3=A9_no=C3=ABl?=": "café noël",
        None: None,
        "\t=?x-nowhere?q?quay?= ": "=?x-nowhere?q?quay?=",
        " \t ": None,
        "Minutes of May": "Minutes of May",
        "=?koi8-r?b?yQ==?=": "и",
        # A letter split between two words, blanks between words, and texts beside them.
        "=?utf-8?b?w?=\r\n =?utf-8?b?6k=?=": "=?utf-8?b?w?=\r\n =?utf-8?b?6k=?=",
        "=?utf-8?q?=C3?=\r\n =?utf-8?q?=A9?=": "é",
        "=?utf-8?q?=C3?= x": "=?utf-8?q?=C3?= x",
        "(=?utf-8?q?a?=)=?iso-8859-1?q?=E9?=b": "(a)é b",
    }
    assert apply(spark, list(cases), headers.decode_words) == list(cases.values())


def random_headers(rng):
    """Words of both kinds, sound and broken, in several character sets, among odd texts."""
    odd = [
        "plain", "a b", "(c", "d)", "x\\", " ", "\t", "\r\n ", "\n", "\x0b", "=?", "?=", "=", "ü", "Ω", "",
        "  \x1c", "\x85", "\u2028", "\x00", "=?utf-8?q? ?=", "=?utf-8?q??=", "=?utf-8?b??=",
        "=?utf-8?b?QQ?=", "=?utf-8?b?QQ=?=", "=?utf-8?b?Q?=", "=?utf-8?b?QUI=?=", "=?utf-8?b?w7w?=",
        "=?utf-8?q?=C3?=", "=?utf-8?q?=BC?=", "=?iso-8859-1?q?=E4_=zz=?=", "=?x?q?a", "=?bogus?q?a?=",
        "=?us-ascii?q?a?=", "=?windows-1252?q?=80?=", "=?utf-8?q?a?b??=", "=?utf8?q?=C3=BC?=",
        "=?utf-8*en?q?x?=", "=?a\nb?q?c?=", "=?utf-8?Q?=ED=A0=80?=", "=?utf-8?q?=EF=BB=BFx?=",
    ]

    def word():
        charset = rng.choice(["utf-8", "UTF-8", "iso-8859-1"])
        raw = rng.choice(["Süß", "a", "x y", "5 €", "", " lead", "tail ", "😀"]).encode(charset, "replace")
        if rng.random() < 0.5:
            return f"=?{charset}?{rng.choice('bB')}?{base64.b64encode(raw).decode()}?="
        return f"=?{charset}?{rng.choice('qQ')}?{''.join(f'={c:02X}' if c != 32 else '_' for c in raw)}?="

    for _ in range(1500):
        kinds = rng.choices([word, lambda: rng.choice([" ", "\r\n ", "text", "("]), lambda: rng.choice(odd)], (5, 3, 2), k=rng.randint(1, 6))
        yield "".join(make() for make in kinds)


def test_header_decoding_equals_the_library(spark):
    raws = list(random_headers(random.Random(5)))
    got = apply(spark, raws, lambda c: F.struct(headers.decode_words(c), headers.is_native(c)))
    assert [r[0] for r in got] == [headers.rfc2047(raw) for raw in raws]
    assert sum(r[1] for r in got) > 500
    native = [raw for raw, r in zip(raws, got, strict=True) if r[1]]
    assert apply(spark, native, headers.native_words) == [headers.rfc2047(raw) for raw in native]


def test_common_headers_stay_out_of_python(spark):
    """Words in utf-8 and latin-1 are decoded without Python, and long ones in one pass."""
    long = "=?utf-8?q?" + "=C3=A9" * 300_000 + "?="
    many = "\r\n ".join(["=?iso-8859-1?q?=E9?="] * 20_000)
    frame = spark.createDataFrame([(long,), (many,)], "v string")
    decoded = frame.select(headers.native_words(F.col("v")).alias("d"))
    assert "Python" not in decoded._jdf.queryExecution().executedPlan().toString()
    assert [r.d for r in decoded.collect()] == ["é" * 300_000, "é" * 20_000]
    assert frame.filter(headers.is_native(F.col("v"))).count() == 2


def in_sets(names):
    """A word in each set alone, blank, empty, and between and beside words in utf-8."""
    for name in names:
        for word in (f"=?{name}?q?a=41?=", f"=?{name}?B?YWI=?=", f"=?{name}?q? ?=", f"=?{name}?q??="):
            yield word
            yield f"=?utf-8?q?x?= {word} =?utf-8?q?=C3=A9?= "
            yield f" see {word}\n(=?koi8-r?b?yQ==?="


def test_unknown_character_sets_equal_the_library(spark):
    """Whether Python is asked or not, the result is its own."""
    names = [*headers.known_sets(), *encodings.aliases.aliases, "Latin-1", "KOI8-R", "cp 1252", "utf-8*en", "unknown-8bit",
             "viscii", "nowhere", "x-utf-8", "utf-9", "a\nb", "a\x0bb", "-", "gb2312", "gb-2312", "hex", "mac_roman"]
    raws = [*in_sets(names), "=?a\nb =?nowhere?q?x?=", "=?utf-8?q?a\x1c=?nowhere?q?x?=", "=?nowhere?q?\x0b?= ?=", "ü =?nowhere?q?x?="]
    assert apply(spark, raws, headers.decode_words) == [headers.rfc2047(raw) for raw in raws]


def test_texts_in_no_known_set_are_not_sent_to_python(spark, monkeypatch):
    sent = F.udf(lambda raw: None if raw is None else f"sent {len(raw)}")
    monkeypatch.setattr(headers, "_decoded", sent)
    raws = ["=?x-nowhere?q?" + "=41" * 90_000 + "?= ", "=?utf-8?q?a?= =?nowhere?b?YQ==?=", "=?koi8-r?b?yQ==?="]
    assert apply(spark, raws, headers.decode_words) == [raws[0].strip(), raws[1], "sent 17"]


def test_date_header_keeps_the_senders_offset():
    dates = {
        "Fri, 3 Oct 2008 19:30:05 -0400": "2008-10-03T19:30:05-04:00",
        "29 Feb 2000 00:00 +0545": "2000-02-29T00:00:00+05:45",
        "1 Jan 99 12:00:00 -0000": "1999-01-01T12:00:00",
        "31 Feb 2008 10:00:00 +0000": None,
        "soon": None,
        None: None,
    }
    assert {raw: headers.rfc5322_iso(raw) for raw in dates} == dates


@pytest.mark.parametrize(
    ("folder", "expected"),
    [
        ("sent", True),
        (".Postausgang", True),
        ("Sent/old", True),
        (".2009.Gesendet", True),
        ("AUSGANG", True),
        ("outbox-copy", True),
        (".Outbox.1999", False),
        ("presents", False),
        ("Vorausgang", False),
        ("ausgangé", False),
    ],
)
def test_sent_folders(spark, folder, expected):
    assert apply(spark, [folder], headers.is_sent_folder) == [expected]


def test_folder_of(spark):
    paths = ["/m/cur/123", "/m/.Archives.2013/cur/123", "/m/a/b/new/1", "/m/123"]
    got = apply(spark, paths, lambda c: headers.folder_of(c, "/m/"))
    assert got == ["INBOX", ".Archives.2013", "a", "INBOX"]


DATES = [
    ("2013-03-12T09:15:00+01:00", "1362000000.x", "INBOX", "header", "2013-03-12T09:15:00+01:00"),
    (None, "1362000000.x", "INBOX", "filename", "2013-02-27T21:20:00+00:00"),
    ("1970-01-01T00:00:00+00:00", "1362000000.x", "INBOX", "filename", "2013-02-27T21:20:00+00:00"),
    ("2100-01-01T00:00:00+00:00", "x", ".A.2007", "folder", "2007-01-01T00:00:00+00:00"),
    (None, "99999999999.x", ".A.2007.B", "folder", "2007-01-01T00:00:00+00:00"),
    (None, "200000000.x", ".A", "none", None),
    (None, "123456789012.x", ".A.2051", "none", None),
    (None, "12345678.x", ".A.20070", "none", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_ladder_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(
            [(i, h, f"/m/cur/{n}", f) for i, (h, n, f, _, _) in enumerate(DATES)],
            "i int, header string, path string, folder string",
        )
        dated = headers.dated(F.col("header"), F.col("path"), F.col("folder")).alias("d")
        got = [(r.d.date_source, r.d.date_parsed) for r in rows.select("i", dated).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(source, parsed) for *_, source, parsed in DATES]


def direction(spark, from_addr, recipients, folder, me):
    schema = "f string, r array<string>, d string"
    rows = spark.createDataFrame([(from_addr, recipients, folder)], schema)
    return rows.select(headers.direction(F.col("f"), F.col("r"), F.col("d"), me)).first()[0]


def test_direction(spark):
    me = ["@Example.com"]
    assert direction(spark, "me@example.com", ["me@example.com"], "INBOX", me) == "out"
    assert direction(spark, "x@else.org", ["me@example.com"], ".Sent Messages", me) == "in"
    assert direction(spark, "x@else.org", ["y@else.org"], ".Gesendet", me) == "out"
    assert direction(spark, "x@else.org", [], "INBOX", []) == "in"
    assert direction(spark, None, None, "INBOX", me) == "unknown"
    # A suffix test, which claims a longer name before the same end as well.
    assert direction(spark, "choir-ida@sings.test", [], "INBOX", ["ida@sings.test"]) == "out"


def test_names(spark):
    sha = "ab" * 32
    cases = [
        ("..\\..\\autoexec/run.bat", "pdf", "....autoexecrun.bat", "PDF"),
        ('a"b\\c\r\nd​ e.x', None, "abcd e.x", "X"),
        (None, "png", "abababababab.png", "PNG"),
        (None, None, "abababababab.bin", "BIN"),
        ("///", None, "abababababab", "///"),
        ("y" * 200, None, "y" * 120, "YYYYY"),
        ("archive.", None, "archive.", "BIN"),
    ]
    rows = spark.createDataFrame(
        [(i, name, ext, sha) for i, (name, ext, _, _) in enumerate(cases)],
        "i int, name string, ext string, sha string",
    )
    got = (
        rows.select(
            "i",
            names.download_name(F.col("name"), F.col("sha"), F.col("ext")).alias("n"),
            names.extension_label(F.col("ext"), F.col("name")).alias("l"),
        )
        .orderBy("i")
        .collect()
    )
    assert [(r.n, r.l) for r in got] == [(n, label) for _, _, n, label in cases]


def test_preview_classes(spark):
    kinds = ["application/pdf", "image/avif", "image/tiff", "text/csv", "text/markdown", ""]
    assert apply(spark, kinds, names.preview_class) == [
        "pdf",
        "image",
        "converted",
        "text",
        "none",
        "none",
    ]


def test_attachment_names(spark):
    sha = "cd" * 32
    cases = [
        ("part.mid", "<x@y>", "png", "part.mid"),
        (None, "<stage@plan>", "png", "stage.png"),
        (None, "<stage@plan>", None, "stage"),
        (None, "<@plan>", "gif", "cdcdcdcdcdcd.gif"),
        (None, None, "gif", None),
    ]
    rows = spark.createDataFrame(
        [(i, n, c, e, sha) for i, (n, c, e, _) in enumerate(cases)],
        "i int, n string, c string, e string, s string",
    )
    name = names.attachment_name(*(F.col(c) for c in "ncse")).alias("r")
    assert [r.r for r in rows.select("i", name).orderBy("i").collect()] == [c[3] for c in cases]


def test_digest_check(spark):
    values = ["a" * 64, "A" * 64, "a" * 63, "a" * 64 + "\n", None]
    assert apply(spark, values, names.is_digest) == [True, False, False, False, False]
