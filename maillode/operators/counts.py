"""Counts that a run keeps up to date by its differences, so that none needs all occurrences.

A run adds what its new rows bring and takes off what replaced rows had, as rows of one sign
each way. The differences of all runs are summed when they are read: they are small beside the
occurrences, and a run that adds nothing to a digest or a facet writes no row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGESTS = "sha256 string, copies long"
FACETS = "facet string, value string, n long, bytes long"


def _changes(new: DataFrame, old: DataFrame, *columns: str) -> DataFrame:
    """Rows that came with sign 1, rows that went with sign -1."""
    plus = new.select(*columns, F.lit(1).cast("long").alias("sign"))
    return plus.unionAll(old.select(*columns, F.lit(-1).cast("long").alias("sign")))


def digest_differences(new: DataFrame, old: DataFrame) -> DataFrame:
    """(sha256, copies): by how much each digest's copies changed, where they did.

    ``new`` and ``old`` are the occurrences that a run added and took away.
    """
    summed = _changes(new, old, "sha256").groupBy("sha256").agg(F.sum("sign").alias("copies"))
    return summed.filter(F.col("copies") != 0)


def facet_differences(
    new: DataFrame,
    old: DataFrame,
    new_messages: DataFrame,
    old_messages: DataFrame,
    new_files: DataFrame,
) -> DataFrame:
    """(facet, value, n, bytes): changes of occurrences by year, by folder and in all, of
    messages, and of distinct files, which are only ever added.

    Occurrences are read once for their three facets, and merged before they are shuffled.
    """

    def one(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))

    def total(rows: DataFrame, facet: str, n: Column, size: Column) -> DataFrame:
        return rows.select(one(facet, F.lit(None)).alias("of"), n.alias("n"), size.alias("bytes"))

    none = F.lit(0).cast("long")
    of = F.array(
        one("year", F.col("year")), one("folder", F.col("folder")), one("occurrences", F.lit(None))
    )
    changes = _changes(new, old, "year", "folder", "size").select(
        F.explode(of).alias("of"),
        F.col("sign").alias("n"),
        (F.col("sign") * F.col("size")).alias("bytes"),
    )
    mail = _changes(new_messages, old_messages)
    changes = changes.unionAll(total(mail, "messages", F.col("sign"), none))
    changes = changes.unionAll(total(new_files, "files", F.lit(1).cast("long"), F.col("size")))
    summed = changes.groupBy("of.facet", "of.value").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("bytes"), none).alias("bytes")
    )
    return summed.filter((F.col("n") != 0) | (F.col("bytes") != 0))


def facet_counts(differences: DataFrame) -> DataFrame:
    """(facet, value, n, bytes) as they stand after all runs; what has gone is left out."""
    summed = differences.groupBy("facet", "value").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    return summed.filter(F.col("n") > 0)


def kept_years(differences: DataFrame) -> DataFrame:
    """The rows of ``browse.facet_years``."""
    years = facet_counts(differences.filter("facet = 'year' AND value IS NOT NULL"))
    return years.select(F.col("value").alias("year")).orderBy(F.desc("year"))


def kept_folders(differences: DataFrame) -> DataFrame:
    """The rows of ``browse.facet_folders``."""
    folders = facet_counts(differences.filter("facet = 'folder'"))
    return folders.select(F.col("value").alias("folder"), "n").orderBy(F.desc("n"), "folder")


def kept_totals(differences: DataFrame) -> DataFrame:
    """The row of ``browse.facet_totals``."""

    def of(facet: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("facet") == facet, F.col(column))), F.lit(0))

    totals = differences.agg(
        of("occurrences", "n").alias("occurrences"),
        of("files", "n").alias("distinct_blobs"),
        of("files", "bytes").alias("unique_bytes"),
        of("occurrences", "bytes").alias("total_bytes"),
        of("messages", "n").alias("messages"),
    )
    return totals.withColumn("saved_bytes", F.col("total_bytes") - F.col("unique_bytes"))
