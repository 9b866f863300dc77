"""One row per distinct file, copy counts, and joins that survive a hot digest.

One file may account for a large share of all occurrences, so nothing here
brings the rows of one digest together: counts and minima are taken before the
shuffle, and rows of hot keys are dealt over many tasks before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import blob_path

# A key is hot from this many rows on. At most rows / HOT_ROWS keys can be, which
# bounds what is broadcast: 2,000 keys for two billion occurrences.
HOT_ROWS = 1_000_000
# Into how many parts the rows of a hot key are dealt.
SALTS = 64

OCCURRENCE_KEY = ("maildir_path", "part_path")


def earliest_first() -> Column:
    """Order that puts the earliest dated occurrence first and undated ones last."""
    return F.struct(
        F.col("date_parsed").isNull(), F.col("date_parsed"), *map(F.col, OCCURRENCE_KEY)
    )


def collapse(view: DataFrame) -> DataFrame:
    """One row per digest: the earliest of the occurrences given."""
    row = F.min_by(F.struct(*map(F.col, view.columns)), earliest_first())
    return view.groupBy("sha256").agg(row.alias("first")).select("first.*")


def representatives(rows: DataFrame, *facts: str) -> DataFrame:
    """Of each digest, the key of its earliest occurrence and some facts of it.

    The narrow form of :func:`collapse`, for choosing before other columns are fetched.
    """
    narrow = F.struct(*dict.fromkeys((*OCCURRENCE_KEY, "date_parsed", *facts)))
    chosen = rows.groupBy("sha256").agg(F.min_by(narrow, earliest_first()).alias("first"))
    return chosen.select("sha256", "first.*")


def digest_counts(attachments: DataFrame) -> DataFrame:
    """(sha256, copies) over all occurrences.

    Here and wherever all occurrences are given for their copies to be counted, the kept
    differences (sha256, copies) of :mod:`.counts` may be given in their place.
    """
    if "copies" in attachments.columns:
        summed = attachments.groupBy("sha256").agg(F.sum("copies").alias("copies"))
        return summed.filter(F.col("copies") > 0)
    return attachments.groupBy("sha256").agg(F.count("*").alias("copies"))


def duplicate_digests(attachments: DataFrame) -> DataFrame:
    return digest_counts(attachments).filter(F.col("copies") > 1)


def join_unique(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join rows to a lookup with one row per key, whatever share one key holds."""
    weights = rows.groupBy(key).agg(F.count("*").alias("__rows"))
    return _salted_join(rows, lookup, weights.filter(F.col("__rows") >= hot_rows), key, how)


def _salted_join(rows, lookup, hot_keys, key, how) -> DataFrame:
    """One join on (key, salt): rows of hot keys are dealt over all salts, and only their
    lookup rows are repeated for each. Cold keys have salt 0 on both sides."""
    hot = F.broadcast(hot_keys.select(key, F.lit(True).alias("__hot")))
    dealt = F.pmod(F.xxhash64(*[c for c in OCCURRENCE_KEY if c in rows.columns] or [key]), SALTS)
    salt = F.when(F.col("__hot"), dealt).otherwise(0).cast("int").alias("__salt")
    every = F.sequence(F.lit(0), F.when(F.col("__hot"), SALTS - 1).otherwise(0))
    left = rows.join(hot, key, "left").select(*rows.columns, salt)
    right = lookup.join(hot, key, "left").select(
        *lookup.columns, F.explode(every).alias("__salt")
    )
    joined = left.join(right, [key, "__salt"], how)
    added = [c for c in lookup.columns if c != key] if how != "left_semi" else []
    return joined.select(*rows.columns, *added)


def with_copies(rows: DataFrame, attachments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``copies``: how often each row's digest occurs among all attachments."""
    counts = digest_counts(attachments)
    hot_keys = counts.filter(F.col("copies") >= hot_rows)
    return _salted_join(rows, counts, hot_keys, "sha256", "inner")


def only_duplicated(
    rows: DataFrame, attachments: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep rows whose digest occurs more than once among all attachments."""
    doubled = duplicate_digests(attachments)
    hot_keys = doubled.filter(F.col("copies") >= hot_rows)
    return _salted_join(rows, doubled.select("sha256"), hot_keys, "sha256", "left_semi")


def blob_rows(attachments: DataFrame) -> DataFrame:
    """One row per distinct file with the occurrence that brings its bytes.

    The first occurrence by path stands for all, so a re-run picks the same one.
    """
    # Size and type follow from the content, so they are grouped by along with its digest.
    same = ["sha256", "size", "sniffed_type", "sniffed_ext"]
    first = F.min(F.struct(*map(F.col, OCCURRENCE_KEY)))
    return (
        attachments.groupBy(*same)
        .agg(first.alias("first"))
        .select(
            "sha256",
            "size",
            blob_path(F.col("sha256")).alias("blob_path"),
            "sniffed_type",
            "sniffed_ext",
            "first.maildir_path",
            "first.part_path",
        )
    )
