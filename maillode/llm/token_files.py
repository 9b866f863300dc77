"""Token ids in flat binary files, written and read by a Spark data source.

A task writes three files: ``<name>.ids`` has the ids of its documents one after the other
as little-endian unsigned integers (of 16 bits if the vocabulary allows, else 32),
``<name>.offsets`` where each document starts in it, in ids, as unsigned 64-bit integers and
one more for the end, and ``<name>.docs`` the documents' numbers as signed 64-bit integers.
When all tasks are done, the driver puts the files in order, adds up where each one starts in
the whole, and writes ``manifest.json``: files that it doesn't name, such as those of a task
that was tried again, don't count. Local files are read through memory maps, and others, such
as ``hdfs://`` and ``s3://``, by ranges.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from .shared import ARROW_ROWS, arrow_rows
from .tokens import encoder

END_ID = 0
#: Pieces that a writing worker remembers (some 200 bytes each). Besides them it holds one batch
#: of rows only.
REMEMBERED = 1_000_000
#: Documents that one reading task takes at most.
READ_DOCUMENTS = 50_000
#: The number that stands for a null id.
NULL_ID = -(1 << 63)
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
IDS = "doc_id long, start long, ids array<long>"


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _array(path: str, name: str, kind: str, start: int, count: int) -> np.ndarray:
    """Part of a file, mapped into memory if the file is local."""
    files, folder = _place(path)
    where = f"{folder}/{name}"
    if count == 0:
        return np.empty(0, kind)
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        return np.memmap(where, kind, "r", start * np.dtype(kind).itemsize, (count,))
    size = np.dtype(kind).itemsize
    with files.open_input_file(where) as source:
        return np.frombuffer(source.read_at(count * size, start * size), kind)


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    documents: int
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: str, width: int):
        self.path, self.vocabulary, self.width = path, vocabulary, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Encodes ``text`` and appends the end id, in the order of the rows."""
        encode = encoder(self.vocabulary, REMEMBERED).batch
        name = uuid.uuid4().hex
        files, folder = _place(self.path)
        first, documents, ids = NULL_ID, 0, 0
        end = END_ID.to_bytes(4, "little")
        with (
            files.open_output_stream(f"{folder}/{name}.ids") as ids_file,
            files.open_output_stream(f"{folder}/{name}.offsets") as offsets_file,
            files.open_output_stream(f"{folder}/{name}.docs") as docs_file,
        ):
            for batch in iterator:
                numbers = batch["doc_id"].fill_null(NULL_ID).to_numpy()
                if len(numbers) and not documents:
                    first = int(numbers[0])
                docs_file.write(numbers.astype("<i8").tobytes())
                for start in range(0, len(batch), 256):
                    packed = encode(batch["text"].slice(start, 256).to_pylist())
                    joined = np.frombuffer(b"".join(x + end for x in packed), "<u4")
                    ids_file.write(joined.astype(f"<u{self.width}").tobytes())
                    lengths = np.array([len(x) // 4 + 1 for x in packed], np.uint64)
                    ends = ids + np.cumsum(lengths)
                    offsets_file.write((ends - lengths).astype("<u8").tobytes())
                    documents, ids = documents + len(packed), int(ends[-1])
            offsets_file.write(np.array([ids], "<u8").tobytes())
        return Written(name, first, documents, ids)

    def commit(self, messages: list[Written | None]) -> None:
        """One entry a file: the bases are prefix sums over the files, by first document."""
        entries, start, documents = [], 0, 0
        filled = [m for m in messages if m is not None and m.documents]
        for one in sorted(filled, key=lambda m: m.first):
            entries.append(
                {"name": one.name, "documents": one.documents, "ids": one.ids,
                 "start": start, "documents_before": documents}
            )
            start, documents = start + one.ids, documents + one.documents
        manifest = {"width": self.width, "ids": start, "documents": documents, "files": entries}
        files, folder = _place(self.path)
        with files.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps(manifest).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        for one in messages:
            for kind in ("ids", "offsets", "docs") if one is not None else ():
                files.delete_file(f"{folder}/{one.name}.{kind}")


@dataclass
class _Part(InputPartition):
    name: str
    first: int
    documents: int
    base: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[_Part]:
        files, folder = _place(self.path)
        with files.open_input_file(f"{folder}/manifest.json") as source:
            manifest = json.loads(source.read())
        return [
            _Part(
                one["name"],
                first,
                min(READ_DOCUMENTS, one["documents"] - first),
                one["start"],
                manifest["width"],
            )
            for one in manifest["files"]
            for first in range(0, one["documents"], READ_DOCUMENTS)
        ]

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        docs = _array(self.path, f"{part.name}.docs", "<i8", part.first, part.documents)
        offsets = _array(self.path, f"{part.name}.offsets", "<u8", part.first, part.documents + 1)
        offsets = offsets.astype(np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        ids = _array(self.path, f"{part.name}.ids", f"<u{part.width}", low, high - low)
        step = 256 if self.with_ids else part.documents
        for start in range(0, part.documents, step):
            edges = offsets[start : start + step + 1]
            numbers = docs[start : start + step]
            common = [
                pa.array(numbers, mask=numbers == NULL_ID),
                pa.array(edges[:-1] + part.base),
            ]
            if self.with_ids:
                some = ids[edges[0] - low : edges[-1] - low].astype(np.int64)
                lists = pa.ListArray.from_arrays((edges - edges[0]).astype(np.int32), some)
                yield pa.RecordBatch.from_arrays([*common, lists], ["doc_id", "start", "ids"])
            else:
                marks = [
                    zlib.crc32(ids[a:b].astype("<u4").tobytes())
                    for a, b in zip((edges[:-1] - low).tolist(), (edges[1:] - low).tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*common, pa.array(np.diff(edges)), pa.array(marks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


class TokenFiles(DataSource):
    """Format ``token_files``. Options: ``path``; to write, ``vocabulary``, a tokenizer's JSON
    file; to read, ``ids`` (``true``: the ids themselves, else their number and crc32)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return IDS if self.options.get("ids") == "true" else DIGEST

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("ids") == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        vocabulary = self.options["vocabulary"]
        width = 2 if len(encoder(vocabulary).width) <= 1 << 16 else 4
        files, folder = _place(self.options["path"])
        if files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
            raise FileExistsError(f"{self.options['path']} isn't empty")
        files.create_dir(folder, recursive=True)
        return _Writer(self.options["path"], vocabulary, width)


def write_token_files(docs: DataFrame, path: str, vocabulary: str) -> None:
    """All whole texts as ids, in ascending order of ``doc_id``; null ids come first.

    A null or empty text has the end id alone. Rows that repeat an id are documents of their
    own, side by side. Other columns are ignored. An empty table gives a manifest without
    files. Fails before any task starts if ``path`` isn't empty.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    writer = ordered.sortWithinPartitions("doc_id").write.format("token_files")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        writer.option("vocabulary", vocabulary).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids before it), then ``ids``, or ``n_tokens`` and ``ids_crc32``."""
    spark.dataSource.register(TokenFiles)
    source = spark.read.format("token_files").option("ids", str(ids).lower()).load(path)
    return source.select(F.col("doc_id"), *source.columns[1:])
