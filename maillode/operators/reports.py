"""Reports over files and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import effective_type, preview_class
from ..functions.text import charset_of
from .dedup import OCCURRENCE_KEY, digest_counts

STORAGE_TYPES = 15
WASTE_FILES = 20
MEBIBYTE = 1_048_576


def storage_by_type(view: DataFrame, top: int = STORAGE_TYPES) -> DataFrame:
    """Where the bytes are: occurrences and whole MiB per detected type, largest first."""
    sums = view.groupBy("sniffed_type").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes")
    )
    mb = sums.select("sniffed_type", "n", F.expr(f"bytes div {MEBIBYTE}").alias("mb"))
    return mb.orderBy(F.desc("mb"), F.asc_nulls_first("sniffed_type")).limit(top)


def wasted_space(view: DataFrame, top: int = WASTE_FILES) -> DataFrame:
    """What duplication costs: size times the copies beyond the first, per file."""
    files = view.groupBy("sha256").agg(
        F.max("size").alias("size"), F.count("*").alias("copies")
    )
    wasted = files.withColumn("wasted", F.col("size") * (F.col("copies") - 1))
    worst = wasted.orderBy(F.desc("wasted"), F.asc("sha256")).limit(top)
    # Names are looked up for the few files of the report only.
    names = view.select("sha256", "filename", *OCCURRENCE_KEY)
    names = names.join(F.broadcast(worst), "sha256").groupBy(*worst.columns)
    named = names.agg(
        F.min_by("filename", F.struct(*map(F.col, OCCURRENCE_KEY))).alias("filename")
    )
    return named.select("sha256", "filename", "size", "copies", "wasted").orderBy(
        F.desc("wasted"), F.asc("sha256")
    )


def type_share(blobs: DataFrame) -> DataFrame:
    """Share of distinct files per detected type."""
    counts = blobs.groupBy("sniffed_type").agg(F.count("*").alias("files"))
    # One row per type, so the total is over a handful of rows.
    total = F.sum("files").over(Window.partitionBy())
    return counts.withColumn("share", F.col("files") / total)


def preview_coverage(blobs: DataFrame) -> DataFrame:
    """One row: how many distinct files are identified, and how many can be shown."""
    shown = preview_class(effective_type(F.col("sniffed_type"), F.col("mime_declared"))) != "none"
    return blobs.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("sniffed_type").isNotNull()).alias("identified"),
        F.count_if(shown).alias("previewable"),
    ).select(
        "*",
        (F.col("identified") / F.col("files")).alias("identified_share"),
        (F.col("previewable") / F.col("files")).alias("previewable_share"),
    )


def most_repeated(view: DataFrame) -> DataFrame:
    """The file with most copies: one row per name it goes by, with the years.

    Names are rows, not a list, as their number has no bound.
    """
    top = (
        digest_counts(view)
        .orderBy(F.desc("copies"), F.asc("sha256"))
        .limit(1)
    )
    return (
        view.join(F.broadcast(top), "sha256")
        .groupBy("sha256", "copies", "size", "filename")
        .agg(
            F.count("*").alias("n"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
    )


def type_mismatch(view: DataFrame) -> DataFrame:
    """Occurrences per pair of declared and detected type that disagree."""
    differ = ~F.col("mime_declared").eqNullSafe(F.col("sniffed_type"))
    return (
        view.filter(differ)
        .groupBy("mime_declared", "sniffed_type")
        .agg(F.count("*").alias("n"))
    )


def charset_counts(contents: DataFrame) -> DataFrame:
    """Text files per step of the character set ladder."""
    return (
        contents.select(charset_of(F.col("content")).alias("encoding"))
        .groupBy("encoding")
        .agg(F.count("*").alias("files"))
    )


def names_by_digest(attachments: DataFrame) -> DataFrame:
    """(sha256, filename): of each file, the name of its first named occurrence."""
    key = F.struct(*map(F.col, OCCURRENCE_KEY))
    named = attachments.filter(F.col("filename").isNotNull())
    return named.groupBy("sha256").agg(F.min_by("filename", key).alias("filename"))
