"""Keeping stored tables up to date: skip, upsert, replace, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .paging import page_in_order, write_order

FILE_STATE = ["maildir_path", "mtime", "size"]

#: Up to so many files the first ones are found as a top-k, which ends in one task.
TOP_FILES = 20_000


def skip_known(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, time and size are not all as stored. Run before reading bytes."""
    return files.join(known.select(*FILE_STATE), FILE_STATE, "left_anti")


def first_files(
    files: DataFrame,
    limit: int | None,
    failed: DataFrame | None = None,
    top_files: int = TOP_FILES,
) -> DataFrame:
    """At most ``limit`` files of a run, lowest paths first; all for None or 0.

    Files that failed in an earlier run come last, so they cannot hold up the rest. Beyond
    ``top_files``, a matter of cost alone, the files are sorted into ranges and written, and
    the first of these are read: no task has all files of the run.
    """
    if not limit:
        return files
    columns = files.columns
    order = [F.asc("maildir_path")]
    if failed is not None:
        before = failed.select("maildir_path", F.lit(True).alias("failed_before")).distinct()
        files = files.join(before, "maildir_path", "left")
        order.insert(0, F.asc("failed_before"))
    if limit <= top_files:
        return files.orderBy(*order).limit(limit).select(*columns)
    path = scratch(files.sparkSession, "first-files")
    write_order(files, order, path)
    return page_in_order(files.sparkSession, path, 0, limit).select(*columns)


def indexable() -> Column:
    """Whether a parsed message was read and can be stored."""
    return (
        F.col("from_addrs").isNotNull()
        & F.col("read_error").isNull()
        & F.col("index_error").isNull()
    )


def failure_rows(
    scanned: DataFrame, parsed: DataFrame, lost: DataFrame | None = None
) -> DataFrame:
    """(maildir_path, part_path, problem) of whatever a run could not take in."""
    whole = F.lit(None).cast("string").alias("part_path")
    unseen_files = scanned.filter(F.col("read_error").isNotNull()).select(
        "maildir_path", whole, F.col("read_error").alias("problem")
    )
    problem = F.coalesce("read_error", "index_error")
    messages = parsed.filter(problem.isNotNull()).select(
        "maildir_path", whole, problem.alias("problem")
    )
    parts = (
        parsed.select("maildir_path", F.explode("parts").alias("part"))
        .filter(F.col("part.part_error").isNotNull())
        .select("maildir_path", "part.part_path", F.col("part.part_error").alias("problem"))
    )
    texts = (
        parsed.select("maildir_path", F.explode("texts").alias("piece"))
        .filter(F.col("piece.text_error").isNotNull())
        .select(
            "maildir_path",
            "piece.part_path",
            F.concat(F.lit("text: "), F.col("piece.text_error")).alias("problem"),
        )
    )
    rows = unseen_files.unionByName(messages).unionByName(parts).unionByName(texts)
    return rows if lost is None else rows.unionByName(lost.select(*rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New rows, and the old ones whose key did not come again."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_children(
    old: DataFrame, new: DataFrame, parents: DataFrame, key: str = "maildir_path"
) -> DataFrame:
    """New child rows, and the old ones of parents that were not read again."""
    return old.join(parents.select(key), key, "left_anti").unionByName(new)


def unseen(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Digests not stored before: the first writer of a digest wins."""
    return blobs.join(stored.select("sha256"), "sha256", "left_anti")


def run_statistics(
    scanned: DataFrame,
    todo: DataFrame,
    parsed: DataFrame,
    attachments: DataFrame,
    new_blobs: DataFrame,
    lost: DataFrame | None = None,
) -> DataFrame:
    """One row counting what a run scanned, skipped, indexed, stored and failed on.

    Messages of which a part was lost count as errors, by parts, and not as indexed. Each
    input is reduced to one row before they are added up.
    """
    failed_parts = F.size(F.filter("parts", lambda p: p["part_error"].isNotNull()))
    broken = F.col("read_error").isNotNull() | F.col("index_error").isNotNull()
    unopened = F.col("from_addrs").isNull() & ~broken
    counts = [
        scanned.select(
            F.count("*").alias("scanned"),
            F.count_if(F.col("read_error").isNotNull()).alias("unseen"),
        ),
        todo.select(F.count("*").alias("read")),
        parsed.select(
            F.count_if(F.col("from_addrs").isNotNull() & ~broken).alias("indexed"),
            (
                F.count_if(broken | unopened)
                + F.coalesce(F.sum(F.when(failed_parts > 0, failed_parts)), F.lit(0))
            ).alias("errors"),
        ),
        attachments.select(F.count("*").alias("attachments")),
        new_blobs.select(F.count("*").alias("new_blobs")),
    ]
    if lost is not None:
        opened = parsed.filter(F.col("from_addrs").isNotNull() & ~broken).select("maildir_path")
        gone = lost.select("maildir_path").distinct().join(opened, "maildir_path", "left_semi")
        counts += [
            gone.select((-F.count("*")).alias("indexed")),
            lost.select(F.count("*").alias("errors")),
        ]
    names = ["scanned", "unseen", "read", "indexed", "attachments", "new_blobs", "errors"]
    padded = [
        one.select(*[F.col(n) if n in one.columns else F.lit(0).alias(n) for n in names])
        for one in counts
    ]
    rows = padded[0]
    for one in padded[1:]:
        rows = rows.unionByName(one)
    total = rows.agg(*[F.sum(n).alias(n) for n in names])
    return total.select(
        "scanned",
        "indexed",
        # A file that could not be examined was neither skipped nor read.
        (F.col("scanned") - F.col("unseen") - F.col("read")).alias("skipped"),
        "attachments",
        "new_blobs",
        (F.col("attachments") - F.col("new_blobs")).alias("dup_blobs"),
        (F.col("errors") + F.col("unseen")).alias("errors"),
    )
