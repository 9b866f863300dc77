"""Views over the index: occurrences, one message with its parts, ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headers import direction, year_of
from ..functions.names import download_name
from ..functions.text import BODY_CHARS, TEXT_VIEW_BYTES, cut_body, text_view
from ..operators.dedup import join_unique
from ..operators.mime import MESSAGE_COLUMNS
from ..operators.reports import names_by_digest
from .store import IndexStore

HEAD_COLUMNS = (
    "folder",
    "subject",
    "from_raw",
    "to_raw",
    "cc_raw",
    "date_parsed",
    "date_raw",
    "message_id",
)
GONE = "[no body is stored for this message]"


def occurrence_view(attachments: DataFrame, blobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Every occurrence with its file and its message, and the year of the date.

    One file may occur anywhere, so that join is split by hot digest. The parts of one
    message are few, as mail servers limit the size of a message, so the join on its path
    is left to Spark; AQE splits it where a mailbox breaks that rule.
    """
    with_file = join_unique(attachments, blobs, "sha256")
    joined = with_file.join(messages, "maildir_path")
    return joined.withColumn("year", year_of(F.col("date_parsed")))


def joined_occurrences(store: IndexStore) -> DataFrame:
    """The occurrence view from the three stored tables."""
    attachments = store.read("attachments").drop("filename_raw", "content_id", "transfer_defects")
    messages = store.read("messages").select("maildir_path", *MESSAGE_COLUMNS)
    return occurrence_view(attachments, store.read("blobs"), messages)


def stored_occurrences(store: IndexStore) -> DataFrame:
    """The same rows as ingest wrote them, so that browsing needs no join."""
    return store.read("occurrences")


def message_heads(
    opened: DataFrame, messages: DataFrame, bodies: DataFrame, body_chars: int = BODY_CHARS
) -> DataFrame:
    """The message of each attachment opened: head fields, body, and whether it was cut.

    Bodies are stored whole; ``body_chars`` of them are shown, and ``body_sha256`` and ``chars``
    tell of the whole one (null if none is stored).
    """
    head = messages.select("maildir_path", *HEAD_COLUMNS)
    shown, cut = cut_body(F.coalesce("body", F.lit(GONE)), body_chars)
    with_body = (
        head.join(bodies.select("maildir_path", "body"), "maildir_path", "left")
        .withColumn("truncated", cut)
        .withColumn("body_sha256", F.sha2("body", 256))
        .withColumn("chars", F.length("body").cast("long"))
        .withColumn("body", shown)
    )
    return opened.select("maildir_path", "part_path").join(with_body, "maildir_path")


def message_parts(opened: DataFrame, attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """All parts of the messages opened, each part once, in text order of its address."""
    messages = opened.select("maildir_path").distinct()
    siblings = attachments.join(messages, "maildir_path", "left_semi")
    return join_unique(siblings, blobs, "sha256").orderBy("maildir_path", "part_path")


def readable_files(
    contents: DataFrame,
    blobs: DataFrame,
    attachments: DataFrame,
    view_bytes: int = TEXT_VIEW_BYTES,
) -> DataFrame:
    """Every stored file by digest: a name to save it under, and its text if it is text.

    ``contents`` are (sha256, content) with one row for each digest; ``view_bytes`` of a text
    file are shown.
    """
    named = names_by_digest(attachments)
    is_text = F.startswith("sniffed_type", F.lit("text/"))
    shown = F.when(is_text, text_view(F.col("content"), F.col("sniffed_type"), view_bytes))
    return (
        contents.select("sha256", "content")
        .join(blobs.select("sha256", "size", "sniffed_type", "sniffed_ext"), "sha256")
        .join(named, "sha256", "left")
        .withColumn("shown", shown)
        .select(
            "sha256",
            "size",
            "sniffed_type",
            download_name(F.col("filename"), F.col("sha256"), F.col("sniffed_ext")).alias(
                "download_name"
            ),
            "shown.text",
            "shown.charset",
            "shown.truncated",
        )
    )


def stored_files(store: IndexStore, view_bytes: int = TEXT_VIEW_BYTES) -> DataFrame:
    """:func:`readable_files` of a stored index; filter on ``sha256`` for one file."""
    contents = store.read("blob_content").filter(F.col("content").isNotNull())
    # A digest that several occurrences supplied in one run has equal contents.
    once = contents.groupBy("sha256").agg(F.any_value("content").alias("content"))
    return readable_files(once, store.read("blobs"), store.read("attachments"), view_bytes)


def rederive_direction(messages: DataFrame, me: Sequence[str]) -> DataFrame:
    """Messages with their direction decided anew, without opening any mail."""
    columns = (F.col(c) for c in ("from_addr", "recipients", "folder"))
    return messages.withColumn("direction", direction(*columns, me))


def register_index(store: IndexStore) -> None:
    """Make every table of a stored index available to ``spark.sql``."""
    for name in ("messages", "attachments", "blobs", "bodies"):
        store.read(name).createOrReplaceTempView(name)
    stored_occurrences(store).createOrReplaceTempView("v_attachments")


def register_views(
    messages: DataFrame, attachments: DataFrame, blobs: DataFrame, view: DataFrame
) -> None:
    """Make the tables and the occurrence view available to ``spark.sql``."""
    messages.createOrReplaceTempView("messages")
    attachments.createOrReplaceTempView("attachments")
    blobs.createOrReplaceTempView("blobs")
    view.createOrReplaceTempView("v_attachments")
