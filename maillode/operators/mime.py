"""MIME messages to rows.

One Arrow stage opens each message once and returns its headers, an array of
its parts and the texts of its body. Every decision about those values is made
afterwards with Column expressions. Digests and the leading bytes are taken in
the stage, so whole attachments leave Python only when a caller asks for them.
"""

from __future__ import annotations

import email.policy
import hashlib
from collections.abc import Iterator, Sequence
from email.message import Message
from email.parser import BytesHeaderParser, BytesParser
from email.policy import EmailPolicy
from email.utils import getaddresses
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import headers, names, text
from ..functions.headers import rfc2047, rfc5322_iso
from ..functions.sniff import CONTAINER_BYTES, sniff, sniff_sql
from ..sources.maildir import read_file

PART = T.StructType(
    [
        T.StructField("part_path", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("filename_raw", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("named", T.BooleanType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("head", T.BinaryType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("decode_failed", T.BooleanType()),
        T.StructField("transfer_defects", T.ArrayType(T.StringType())),
        T.StructField("part_error", T.StringType()),
    ]
)
BODY_PIECE = T.StructType(
    [
        T.StructField("part_path", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_error", T.StringType()),
    ]
)
PARSED = T.StructType(
    [
        T.StructField("read_error", T.StringType()),
        T.StructField("parse_error", T.StringType()),
        T.StructField("index_error", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("from_raw", T.StringType()),
        T.StructField("to_raw", T.StringType()),
        T.StructField("cc_raw", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("from_addrs", T.ArrayType(T.StringType())),
        T.StructField("to_addrs", T.ArrayType(T.StringType())),
        T.StructField("date_raw", T.StringType()),
        T.StructField("date_header", T.StringType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("texts", T.ArrayType(BODY_PIECE)),
        T.StructField("body_error", T.StringType()),
    ]
)
RECIPIENT_HEADERS = ("To", "Cc", "Bcc", "Delivered-To")
BODY_TYPES = ("text/plain", "text/html")

ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 32 << 20


# --- the stage: one message in, one record out -------------------------------


SHORT_HEADER = 1000


def modern_policy() -> EmailPolicy:
    """The modern policy, parsing equal headers once.

    It parses a header anew at each look, some forty times a message. Parsed
    headers are immutable and mostly repeat, so each task keeps the short ones.
    """
    parse = email.policy.default.header_factory
    parse_kept = lru_cache(maxsize=8192)(parse)

    def parse_header(name: str, value: str):
        return (parse_kept if len(value) <= SHORT_HEADER else parse)(name, value)

    return email.policy.default.clone(header_factory=parse_header)


# What the stored note on a parse says before the error.
FALLBACK_NOTE, UNPARSEABLE_NOTE = "compat32 fallback", "unparseable"


def read_message(
    raw: bytes, modern: EmailPolicy, headers_only: bool = False
) -> tuple[Message | None, str | None]:
    """The message, and what stood in the way of the modern policy.

    With ``headers_only`` the body isn't taken apart, so faults of its structure don't show.
    """
    parser = BytesHeaderParser if headers_only else BytesParser
    try:
        return parser(policy=modern).parsebytes(raw), None
    except Exception as exc:
        modern_fault = exc
    try:
        lenient = parser(policy=email.policy.compat32).parsebytes(raw)
    except Exception as exc:
        return None, f"{UNPARSEABLE_NOTE}: {exc!r}"
    return lenient, f"{FALLBACK_NOTE}: {modern_fault!r}"


def addressed_parts(message: Message) -> Iterator[tuple[str, Message]]:
    """Leaves of the MIME tree in reading order, each with its dotted address.

    An attached message is a leaf and is opened as well. When it has a single
    part, that part's address ends in a dot.
    """
    to_open = [("", message, False)]
    while to_open:
        address, node, is_leaf = to_open.pop()
        if is_leaf:
            yield address, node
            continue
        if not node.is_multipart():
            yield address or "1", node
            continue
        children = node.get_payload()
        if not isinstance(children, list):
            continue
        found = []
        for number, child in enumerate(children, start=1):
            here = f"{address}{number}"
            if child.get_content_type() == "message/rfc822":
                found.append((here, child, True))
                inner = child.get_payload()
                if isinstance(inner, list) and inner:
                    inner = inner[0]
                if isinstance(inner, Message):
                    found.append((here + ".", inner, False))
            elif child.is_multipart():
                found.append((here + ".", child, False))
            else:
                found.append((here, child, True))
        to_open.extend(reversed(found))


def leaf_content(leaf: Message) -> tuple[bytes | None, bool]:
    """The decoded bytes of a leaf, and whether there was no decoding it.

    An attached message is a leaf without bytes of its own. Broken encodings are repaired by
    the library and leave a defect; only an unreadable encoding header stops it, and that
    stops every other look at the payload as well.
    """
    if leaf.is_multipart():
        return None, True
    try:
        return leaf.get_payload(decode=True), False
    except Exception:
        return None, True


def _described(leaf: Message, content: bytes | None) -> dict:
    """What the part's headers say, and the digest and leading bytes of its content."""
    declared = leaf.get_filename()
    raw_name = leaf.get_param("name", header="content-type") if declared is None else declared
    raw_name = _storable(str(raw_name)) if raw_name else None
    content_id = leaf.get("Content-ID")
    record = {
        "content_type": _storable((leaf.get_content_type() or "").lower() or None),
        "disposition": _storable(leaf.get_content_disposition()),
        "named": bool(declared),
        "filename_raw": raw_name,
        "filename": _storable(rfc2047(raw_name)),
        "content_id": _storable(str(content_id)) if content_id else None,
        "transfer_defects": [type(d).__name__ for d in leaf.defects],
    }
    if content is not None:
        record["size"] = len(content)
        record["sha256"] = hashlib.sha256(content).hexdigest()
        record["head"] = content[:CONTAINER_BYTES]
    return record


def _readable(leaf: Message, content: bytes | None) -> dict | None:
    """The text that a leaf adds to the body of its message, or why it can't be told.

    A leaf that isn't text adds none, whatever its other headers are like.
    """
    piece: dict = {}
    try:
        piece["content_type"] = kind = leaf.get_content_type()
        if content is None or kind not in BODY_TYPES:
            return None
        if leaf.get_content_disposition() == "attachment":
            return None
        charset = leaf.get_content_charset() or "utf-8"
    except Exception as exc:
        return piece | {"text_error": str(exc)}
    try:
        shown = content.decode(charset, "replace")
    except (LookupError, ValueError):  # no such character set
        return None
    return piece | {"text": shown.encode("utf-8", "replace").decode("utf-8")}


def _part_record(address: str, leaf: Message, content: bytes | None, parts: str) -> dict:
    """A leaf's description, or why there is none."""
    record: dict = {"part_path": address}
    try:
        record["part_path"] = _storable(address)
        record |= _described(leaf, content)
        record["content"] = content if parts == "content" else None
    except Exception as exc:
        record["part_error"] = repr(exc)
    return record


def tree_record(message: Message, parts: str | None, bodies: bool) -> dict:
    """Parts and body texts from one walk, in which every leaf is decoded once.

    What a part is and what it says fail independently, and no part's failure touches another's:
    ``part_error`` and ``text_error`` stand with the part. There is a ``body_error`` only if a
    text was lost and none was read.
    """
    described, texts = [], []
    walk = addressed_parts(message)
    while True:
        try:
            address, leaf = next(walk)
        except StopIteration:
            break
        except Exception as exc:  # the rest of the tree is out of reach
            described.append({"part_path": "?", "part_error": repr(exc)})
            texts.append({"part_path": "?", "text_error": str(exc)})
            continue
        content, undecoded = leaf_content(leaf)
        if parts:
            record = _part_record(address, leaf, content, parts)
            described.append(record | {"decode_failed": undecoded})
        if bodies and (piece := _readable(leaf, content)):
            texts.append({"part_path": address} | piece)
    out: dict = {"parts": described} if parts else {}
    if bodies:
        out["texts"] = texts
        lost = [piece["text_error"] for piece in texts if "text_error" in piece]
        if lost and len(lost) == len(texts):
            out["body_error"] = f"[this message's text can't be read: {lost[0]}]"
    return out


def header_record(message: Message) -> dict:
    def decoded(name: str) -> str | None:
        value = message.get(name)
        return _storable(rfc2047(str(value))) if value else None

    date = _storable(_date_header(message))
    return {
        "message_id": decoded("Message-ID"),
        "from_raw": decoded("From"),
        "to_raw": decoded("To"),
        "cc_raw": decoded("Cc"),
        "subject": decoded("Subject"),
        "from_addrs": addresses(message, ("From",)),
        "to_addrs": addresses(message, RECIPIENT_HEADERS),
        "date_raw": date,
        "date_header": rfc5322_iso(_squeezed(date)),
    }


def _date_header(message: Message) -> str | None:
    try:
        value = message.get("Date")
        return str(value) if value else None
    except Exception:
        return None


def _squeezed(value: str | None) -> str | None:
    return " ".join(value.replace("\x00", "").split()) if value else None


def addresses(message: Message, header_names: Sequence[str]) -> list[str]:
    """Addresses holding an @, in order; a header that will not parse gives none."""
    found: list[str] = []
    for name in header_names:
        try:
            values = [str(value) for value in message.get_all(name, [])]
            found += [_storable(addr) for _, addr in getaddresses(values) if "@" in addr]
        except Exception:
            continue
    return found


def _storable(value: str | None) -> str | None:
    """Refuse text that no UTF-8 column can hold, as the row could not be stored."""
    if value is not None:
        value.encode("utf-8")
    return value


def message_record(
    raw: bytes | None,
    read_error: str | None,
    parts: str | None,
    bodies: bool,
    modern: EmailPolicy,
    headers_only: bool = False,
) -> dict:
    if raw is None:
        return {"read_error": read_error or "no bytes"}
    message, parse_error = read_message(raw, modern, headers_only)
    record = {"parse_error": parse_error}
    if message is None:
        return record
    try:
        record |= header_record(message)
    except Exception as exc:
        return record | {"index_error": repr(exc)}
    if parts or bodies:
        record |= tree_record(message, parts, bodies)
    return record


# --- DataFrames in, DataFrames out -------------------------------------------


def parse_messages(
    messages: DataFrame,
    *,
    parts: str | None = "meta",
    bodies: bool = False,
    headers_only: bool = False,
) -> DataFrame:
    """Open each message of (raw BINARY, ...) and add the PARSED columns for it.

    ``parts``: None skips the MIME tree, "meta" describes each part, "content"
    carries its bytes too. ``bodies`` adds the texts of the body. ``headers_only``, for
    callers that want neither, leaves the rest of the mail alone. Other columns
    are kept. Nothing outside the stage can prune what it computes, so ask for
    no more than is used.
    """
    return _message_stage(messages, "raw", lambda raw: (raw, None), parts, bodies, headers_only)


def parse_files(files: DataFrame, *, parts: str | None = "meta", bodies: bool = False) -> DataFrame:
    """Same for (maildir_path, ...): the file is read inside the stage that parses it."""
    return _message_stage(files, "maildir_path", read_file, parts, bodies)


def _message_stage(
    source: DataFrame, column: str, load, parts, bodies, headers_only=False
) -> DataFrame:
    kept = [f for f in source.schema.fields if f.name != "raw"]
    schema = T.StructType(kept + PARSED.fields)
    kept_names = [f.name for f in kept]
    arrow_types = [(f.name, to_arrow_type(f.dataType)) for f in PARSED.fields]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch, start, stop, records):
            columns = batch.select(kept_names).slice(start, stop - start).columns
            added = [pa.array([r.get(n) for r in records], t) for n, t in arrow_types]
            return pa.RecordBatch.from_arrays(
                columns + added, kept_names + [n for n, _ in arrow_types]
            )

        modern = modern_policy()
        for batch in batches:
            inputs = batch.column(batch.schema.get_field_index(column))
            start, held, records = 0, 0, []
            for i in range(len(inputs)):
                raw, problem = load(inputs[i].as_py())
                records.append(message_record(raw, problem, parts, bodies, modern, headers_only))
                held += len(raw or b"")
                if held >= BYTES_PER_BATCH or len(records) == ROWS_PER_BATCH:
                    yield emit(batch, start, i + 1, records)
                    start, held, records = i + 1, 0, []
            if records:
                yield emit(batch, start, len(inputs), records)

    return source.mapInArrow(stage, schema)


def is_attachment(part: Column) -> Column:
    """Whether a part is kept as a file: every leaf that isn't text of the message itself."""
    kind = F.coalesce(part["content_type"], F.lit(""))
    body_like = F.startswith(kind, F.lit("text/")) | (kind == "message/rfc822")
    return ~F.startswith(kind, F.lit("multipart/")) & (
        part["disposition"].eqNullSafe("attachment")
        | F.coalesce(part["named"], F.lit(False))
        | part["content_id"].isNotNull()
        | ~body_like
    )


def explode_parts(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per leaf of each MIME tree, as the struct column ``part``."""
    return parsed.select("maildir_path", *keep, F.explode("parts").alias("part"))


def with_kinds(parsed: DataFrame) -> DataFrame:
    """Put the detected type of each part in place of its bytes, for storing."""
    kept = [f for f in PART.names if f not in ("head", "content")]
    fields = ", ".join(f"'{f}', p.{f}" for f in kept)
    described = f"named_struct({fields}, 'kind', {sniff_sql('p.head')})"
    return parsed.withColumn("parts", F.expr(f"transform(parts, p -> {described})"))


def _kind_of_part(parsed: DataFrame) -> Column:
    fields = parsed.schema["parts"].dataType.elementType.names
    return F.col("part.kind") if "kind" in fields else sniff("part.head")


def attachment_rows(
    parsed: DataFrame, min_size: int = 1, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per attachment occurrence, with its detected type and final name.

    A message that could not be indexed gets none, as it is tried again next time.
    ``keep`` names further columns to carry along.
    """
    part = F.col("part")
    indexed = parsed.filter(F.col("index_error").isNull())
    kept = explode_parts(indexed, keep).filter(
        part["part_error"].isNull()
        & is_attachment(part)
        & part["size"].isNotNull()
        & (part["size"] >= min_size)
    )
    return (
        kept.withColumn("kind", _kind_of_part(parsed))
        .withColumn("content_id", text.clean(part["content_id"]))
        .withColumn("named_as", text.clean(part["filename"]))
        .select(
            "maildir_path",
            part["part_path"].alias("part_path"),
            part["sha256"].alias("sha256"),
            names.attachment_name(
                F.col("named_as"), F.col("content_id"), part["sha256"], F.col("kind.sniffed_ext")
            ).alias("filename"),
            part["filename_raw"].alias("filename_raw"),
            part["content_type"].alias("mime_declared"),
            part["disposition"].alias("disposition"),
            "content_id",
            part["decode_failed"].alias("decode_failed"),
            part["transfer_defects"].alias("transfer_defects"),
            part["size"].alias("size"),
            "kind.sniffed_type",
            "kind.sniffed_ext",
            *keep,
        )
    )


def first_address(addrs: Column) -> Column:
    return F.lower(F.try_element_at(addrs, F.lit(1)))


def all_addresses(addrs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(addrs, F.lower)))


def message_rows(
    parsed: DataFrame, me: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per message that could be indexed; needs folder, mtime and size."""
    recipients = all_addresses(F.coalesce("to_addrs", F.array().cast("array<string>")))
    opened = F.col("from_addrs").isNotNull()
    return (
        parsed.filter(F.col("read_error").isNull() & F.col("index_error").isNull())
        .withColumn("from_addr", first_address(F.col("from_addrs")))
        .withColumn("recipients", recipients)
        .withColumn(
            "dated", headers.dated(F.col("date_header"), F.col("maildir_path"), F.col("folder"))
        )
        .select(
            "maildir_path",
            "folder",
            "mtime",
            "size",
            text.clean(F.col("message_id")).alias("message_id"),
            "from_addr",
            text.clean(F.col("from_raw")).alias("from_raw"),
            text.clean(F.col("to_raw")).alias("to_raw"),
            text.clean(F.col("cc_raw")).alias("cc_raw"),
            "recipients",
            text.clean(F.col("subject")).alias("subject"),
            text.clean(F.col("date_raw")).alias("date_raw"),
            # A message no policy could open keeps only where it lies.
            F.when(opened, F.col("dated.date_parsed")).alias("date_parsed"),
            F.when(opened, F.col("dated.date_parsed").try_cast("timestamp")).alias("date_ts"),
            F.when(opened, F.col("dated.date_source")).otherwise("none").alias("date_source"),
            F.when(
                opened,
                headers.direction(F.col("from_addr"), F.col("recipients"), F.col("folder"), me),
            )
            .otherwise("unknown")
            .alias("direction"),
            "parse_error",
            *keep,
        )
    )


# What an occurrence takes from its message.
MESSAGE_COLUMNS = (
    "folder",
    "direction",
    "subject",
    "from_addr",
    "from_raw",
    "to_raw",
    "date_parsed",
)


def occurrence_rows(parsed: DataFrame, me: Sequence[str], min_size: int = 1) -> DataFrame:
    """The occurrence view straight from parsed mail: a part knows its message, so no join."""
    messages = message_rows(parsed, me, keep=("parts", "index_error"))
    rows = attachment_rows(messages, min_size, keep=MESSAGE_COLUMNS)
    return rows.withColumn("blob_path", names.blob_path(F.col("sha256"))).withColumn(
        "year", headers.year_of(F.col("date_parsed"))
    )


def body_rows(parsed: DataFrame) -> DataFrame:
    """(maildir_path, body) for every message that was opened, whole.

    Of the texts, those that could be read; if there were some and none could, the reason.
    """
    read = F.filter("texts", lambda piece: piece["text"].isNotNull())
    body = F.coalesce("body_error", text.body_text(read))
    opened = parsed.filter(F.col("texts").isNotNull())
    return opened.select("maildir_path", body.alias("body"))
