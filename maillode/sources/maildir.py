"""Maildir trees as DataFrames.

Listing and reading are separate steps. The ``maildir`` data source yields
paths only, one task per group of directories, so no list of files ever passes
through the driver. Sizes and times are then read in tasks spread by path, so a
directory holding most of the archive does not stay in one task, and bytes are
read only for the files a run still needs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MaillodeError
from ..functions.headers import folder_of

MESSAGE_DIRS = ("cur", "new")
SKIPPED_DIR = "tmp"
LISTING_BATCH = 10_000


class DirectoryGroup(InputPartition):
    """Some of the cur and new directories, listed by one task."""

    def __init__(self, directories: list[str], errors: list[tuple[str, str]]):
        self.directories = directories
        self.errors = errors


class MaildirSource(DataSource):
    """``spark.read.format("maildir").load(root)``: one row per message file."""

    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return "maildir_path string, scan_error string"

    def reader(self, schema) -> DataSourceReader:
        return MaildirReader(self.options["path"], int(self.options.get("maxtasks", 4096)))


class MaildirReader(DataSourceReader):
    def __init__(self, root: str, max_tasks: int):
        self.root = root
        self.max_tasks = max_tasks

    def partitions(self) -> list[InputPartition]:
        errors: list[tuple[str, str]] = []
        directories = sorted(message_directories(self.root, errors))
        groups = max(1, min(len(directories), self.max_tasks))
        return [
            DirectoryGroup(directories[i::groups], errors if i == 0 else [])
            for i in range(groups)
        ]

    def read(self, partition: DirectoryGroup) -> Iterator[pa.RecordBatch]:
        batch: list[tuple[str, str | None]] = list(partition.errors)
        for directory in partition.directories:
            for path, error in message_files(directory):
                batch.append((storable_path(path), error))
                if len(batch) == LISTING_BATCH:
                    yield _path_batch(batch)
                    batch = []
        yield _path_batch(batch)


def storable_path(path: str) -> str:
    """A path as text. One that is not UTF-8 is spelled out, and then fails to open."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _path_batch(batch: list[tuple[str, str | None]]) -> pa.RecordBatch:
    paths, errors = zip(*batch, strict=True) if batch else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(errors, pa.string())],
        ["maildir_path", "scan_error"],
    )


def message_directories(root: str, errors: list[tuple[str, str]]) -> Iterator[str]:
    """The outermost cur and new directories; their contents are left to the tasks.

    A directory that can't be listed goes to ``errors`` with the reason.
    """
    pending = [root]
    while pending:
        directory = pending.pop()
        name = os.path.basename(directory)
        if name == SKIPPED_DIR:
            continue
        if name in MESSAGE_DIRS:
            yield directory
            continue
        try:
            with os.scandir(directory) as entries:
                pending += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        except OSError as exc:
            errors.append((storable_path(directory), f"listing failed: {exc}"))


def message_files(directory: str) -> Iterator[tuple[str, str | None]]:
    """Message files of one cur or new directory and of any nested below it.

    A directory that can't be listed comes as its own path and the reason.
    """
    pending = [directory]
    while pending:
        current = pending.pop()
        if os.path.basename(current) == SKIPPED_DIR:
            continue
        holds_messages = os.path.basename(current) in MESSAGE_DIRS
        try:
            with os.scandir(current) as entries:
                for entry in entries:
                    if entry.is_dir():
                        if not entry.is_symlink():
                            pending.append(entry.path)
                    elif holds_messages and not entry.name.startswith("."):
                        yield entry.path, None
        except OSError as exc:
            yield current, f"listing failed: {exc}"


def resolve_root(root: str) -> str:
    """Absolute path of an existing mail directory."""
    path = Path(root).expanduser().resolve()
    if not path.is_dir():
        raise MaillodeError(f"no such mail directory: {path}")
    return str(path)


def scan_maildir(spark: SparkSession, root: str) -> DataFrame:
    """(maildir_path, folder, scan_error) of every message file under the root.

    A directory that can't be listed is a row with its ``scan_error``.
    """
    root = resolve_root(root)
    spark.dataSource.register(MaildirSource)
    paths = spark.read.format("maildir").load(root)
    folder = folder_of(F.col("maildir_path"), root).alias("folder")
    return paths.select("maildir_path", folder, "scan_error")


def with_file_stats(files: DataFrame) -> DataFrame:
    """Add (mtime, size, read_error); a file that cannot be examined keeps its row."""
    added = "mtime double, size long, read_error string"
    # A stated number, so that the tasks are not merged for holding few bytes.
    spark = files.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        4 * spark.sparkContext.defaultParallelism,
    )
    if "scan_error" not in files.columns:
        files = files.withColumn("scan_error", F.lit(None).cast("string"))
    spread = files.repartition(tasks, "maildir_path")
    stated = _map_arrow(spread, added, _stat_batch)
    return stated.withColumn("read_error", F.coalesce("scan_error", "read_error")).drop(
        "scan_error"
    )


def with_file_bytes(files: DataFrame) -> DataFrame:
    """Add (raw, read_error). For use by a stage that needs whole files as a column."""
    return _map_arrow(files, "raw binary, read_error string", _bytes_batch)


def read_file(path: str) -> tuple[bytes | None, str | None]:
    try:
        with open(path, "rb") as handle:
            return handle.read(), None
    except FileNotFoundError:
        return None, "file not found"
    except OSError as exc:
        return None, f"read failed: {exc}"


def _stat_batch(paths: list[str]) -> Iterator[tuple[int, int, list[pa.Array]]]:
    mtimes, sizes, errors = [], [], []
    for path in paths:
        try:
            st = os.stat(path)
            found = (st.st_mtime, st.st_size, None)
        except OSError as exc:
            found = (None, None, f"stat failed: {exc}")
        mtimes.append(found[0])
        sizes.append(found[1])
        errors.append(found[2])
    yield (
        0,
        len(paths),
        [
            pa.array(mtimes, pa.float64()),
            pa.array(sizes, pa.int64()),
            pa.array(errors, pa.string()),
        ],
    )


BYTES_PER_BATCH = 32 << 20


def _bytes_batch(paths: list[str]) -> Iterator[tuple[int, int, list[pa.Array]]]:
    start, held, contents, errors = 0, 0, [], []
    for i, path in enumerate(paths):
        raw, error = read_file(path)
        contents.append(raw)
        errors.append(error)
        held += len(raw or b"")
        if held >= BYTES_PER_BATCH or i + 1 == len(paths):
            arrays = [pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
            yield start, i + 1, arrays
            start, held, contents, errors = i + 1, 0, [], []


def _map_arrow(files: DataFrame, added: str, work) -> DataFrame:
    """Append columns computed from the path, keeping the columns already there."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("maildir_path")).to_pylist()
            for start, stop, arrays in work(paths):
                if names is None:
                    names = batch.schema.names + [part.split()[0] for part in added.split(", ")]
                kept = batch.slice(start, stop - start).columns
                yield pa.RecordBatch.from_arrays(kept + arrays, names)

    return files.mapInArrow(stage, f"{schema}, {added}")
