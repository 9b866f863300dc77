"""Maildir and blob streams.

Both run their work in ``foreachBatch`` against stored tables, so what is kept
between batches lies in those tables and not in ever-growing stream state.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..functions.headers import folder_of
from ..operators.incremental import unseen
from ..plans.ingest import IngestOptions, ingest_files
from ..sources.maildir import MaildirReader, resolve_root


class MaildirStream(DataSource):
    """``readStream.format("maildir_stream")``: a batch is all that a scan finds.

    Offsets are the times of scans. What is new among the files is for the sink to
    tell, by the stored index: so changed files are found as well, at any depth and
    under any name, and nothing has to be remembered here.
    """

    @classmethod
    def name(cls) -> str:
        return "maildir_stream"

    def schema(self) -> str:
        return "maildir_path string, scan_error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ScanReader(self.options["path"])


class _ScanReader(DataSourceStreamReader):
    def __init__(self, root: str, max_tasks: int = 4096):
        self.scanner = MaildirReader(root, max_tasks)

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        return {"scan": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.scanner.partitions()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.scanner.read(partition)


def scans(spark: SparkSession, maildir: str) -> DataFrame:
    """Stream of (maildir_path, folder, scan_error), a whole scan of the tree at a time."""
    root = resolve_root(maildir)
    spark.dataSource.register(MaildirStream)
    files = spark.readStream.format("maildir_stream").option("path", root).load()
    folder = folder_of(F.col("maildir_path"), root).alias("folder")
    return files.select("maildir_path", folder, "scan_error")


def stream_ingest(
    spark: SparkSession,
    maildir: str,
    out: str,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    every: str | None = None,
) -> StreamingQuery:
    """Index new and changed mail into the store, once, or again and again.

    Without ``every``, such as ``"10 minutes"``, one scan is indexed and the stream stops.
    A batch repeated after a failure finds its files already stored and skips them.
    """

    def run_batch(files: DataFrame, batch: int) -> None:
        ingest_files(files, out, options)

    writer = (
        scans(spark, maildir)
        .writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_first_seen(occurrences: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to ``out`` the digests of (sha256, size) not seen in any earlier batch.

    Each batch owns one directory, so a repeated batch replaces its own output.
    """

    def run_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        first = rows.groupBy("sha256").agg(F.max("size").alias("size"))
        if batch > 0:
            stored = spark.read.schema("sha256 string, batch long").parquet(out)
            first = unseen(first, stored.filter(F.col("batch") < batch))
        first.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        occurrences.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
