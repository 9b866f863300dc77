"""The stored index: Parquet tables under one root, versioned by a manifest.

A version names the directories that make up each table. A run writes new
directories first and its manifest last, so readers see either all of a run or
none of it, and a run that dies leaves nothing visible. One writer at a time.

The tables that follow messages are written in buckets by path. Where messages are
read again, their buckets are written anew and passed over in the older directories;
all other buckets' files stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MaillodeError
from ..operators.counts import DIGESTS, FACETS

SCHEMAS = {
    "messages": "maildir_path string, folder string, mtime double, size long,"
    " message_id string, from_addr string, from_raw string, to_raw string, cc_raw string,"
    " recipients array<string>, subject string, date_raw string, date_parsed string,"
    " date_ts timestamp, date_source string, direction string, parse_error string",
    "attachments": "maildir_path string, part_path string, sha256 string, filename string,"
    " filename_raw string, mime_declared string, disposition string, content_id string,"
    " decode_failed boolean, transfer_defects array<string>",
    "blobs": "sha256 string, size long, blob_path string, sniffed_type string,"
    " sniffed_ext string",
    "blob_content": "sha_prefix string, sha256 string, content binary, content_error string",
    "bodies": "maildir_path string, body string",
    # Attachments with their file and their message: what browsing reads.
    "occurrences": "maildir_path string, part_path string, sha256 string, filename string,"
    " mime_declared string, disposition string, decode_failed boolean, size long,"
    " blob_path string, sniffed_type string, sniffed_ext string, folder string,"
    " direction string, subject string, from_addr string, from_raw string, to_raw string,"
    " date_parsed string, year string",
    # What each run changed of copies and facets; their sums are what there is.
    "digest_counts": DIGESTS,
    "facet_counts": FACETS,
    "failures": "run string, maildir_path string, part_path string, problem string",
    "runs": "run string, scanned long, indexed long, skipped long, attachments long,"
    " new_blobs long, dup_blobs long, errors long",
}
MANIFEST = "version long, table_name string, directory string, without array<int>"
#: Tables with a row or more for each message, which change with it.
BUCKETED = ("messages", "attachments", "bodies", "occurrences")
BUCKETS = 64


@dataclass(frozen=True)
class Directory:
    """One run's part of a table, and the buckets in it that later runs have replaced."""

    path: str
    without: tuple[int, ...] = ()


def bucket_of(path: str = "maildir_path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class IndexStore:
    """The tables of one mailbox. ``root`` is any path Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def manifest(self) -> tuple[int, dict[str, list[Directory]]]:
        """Current version number and the directories of each table; (0, {}) when new.

        Versions are numbered without gaps, so the newest is found by doubling and halving,
        and it alone is read: one row per table and run since its last rewrite.
        """
        low, high = 0, 1
        while self._manifest(high) is not None:
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._manifest(middle) is not None else (low, middle)
        while low:
            rows = self._manifest(low).orderBy("directory").collect()
            if rows:
                break
            low -= 1  # a run died while it wrote this one
        directories: dict[str, list[Directory]] = {}
        for row in rows if low else ():
            found = Directory(row.directory, tuple(row.without))
            directories.setdefault(row.table_name, []).append(found)
        return low, directories

    def _manifest(self, version: int) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(self._version_path(version))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _version_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:09d}"

    def exists(self) -> bool:
        return self.manifest()[0] > 0

    def read(self, name: str) -> DataFrame:
        """A table of the current version, empty when nothing was written to it yet."""
        return self.read_from(self.manifest()[1], name)

    def read_from(self, directories: dict[str, list[Directory]], name: str) -> DataFrame:
        parts: dict[tuple[int, ...], list[str]] = {}
        for one in directories.get(name, []):
            parts.setdefault(one.without, []).append(f"{self.root}/{one.path}")
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        frames = []
        for without, paths in parts.items():
            if name in BUCKETED:
                # The buckets are directories, so what is left out is never opened.
                reader = self.spark.read.option("basePath", f"{self.root}/{name}")
                found = reader.schema(SCHEMAS[name] + ", run string, bucket int").parquet(*paths)
                frames.append(found.filter(~F.col("bucket").isin(*without)) if without else found)
            else:
                frames.append(self.spark.read.schema(SCHEMAS[name]).parquet(*paths))
        rows = reduce(DataFrame.unionByName, frames)
        return rows.select(*self.columns(name))

    def columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def rows_of_buckets(
        self, directories: dict[str, list[Directory]], name: str, buckets: list[int]
    ) -> DataFrame:
        """The current rows in these buckets only."""
        others = tuple(b for b in range(BUCKETS) if b not in set(buckets))
        inside = [
            Directory(d.path, tuple(sorted({*d.without, *others})))
            for d in directories.get(name, [])
        ]
        return self.read_from({name: inside}, name)

    def write(self, frame: DataFrame, name: str, run: str) -> Directory:
        """Write rows of one table for a run; a repeated write replaces the earlier one."""
        columns = self.columns(name)
        directory = Directory(f"{name}/run={run}" if name in BUCKETED else f"{name}/{run}")
        rows = frame.select(*columns)
        if name in BUCKETED:
            rows = rows.withColumn("bucket", bucket_of())
        writer = rows.write.mode("overwrite")
        if name in BUCKETED:
            writer = writer.partitionBy("bucket")
        if "sha256" in columns:
            # Lets the lookup of one digest pass over files and row groups without it.
            writer = writer.option("parquet.bloom.filter.enabled#sha256", "true")
        writer.parquet(f"{self.root}/{directory.path}")
        return directory

    def commit(self, directories: dict[str, list[Directory]], version: int) -> None:
        """Make these directories the given version."""
        rows = [
            (version, name, one.path, list(one.without))
            for name, found in directories.items()
            for one in found
        ]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(self._version_path(version))


def open_index(spark: SparkSession, root: str) -> IndexStore:
    """An index that must already have been built."""
    store = IndexStore(spark, root)
    if not store.exists():
        raise MaillodeError(f"no index at {root}: run an ingest first")
    return store
