"""What the operators of this subpackage have in common: inputs, the shared folder, ranks."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lasting(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks.

    Functions of this package travel to the workers with each task, and their modules' global
    variables with them, so these don't last; an attribute of ``sys`` does.
    """
    kept = vars(sys).setdefault("_maillode_lasting", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


@contextmanager
def no_collections() -> Iterator[None]:
    """Python's search for reference cycles is off in this block and passes over what the block
    has made later on, as it would go through all that a worker has learned again and again.
    What has no cycles is freed without it."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, as in tests; any other master
    is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = ("folder", spark.sparkContext.applicationId)
        folder = lasting(own, lambda: tempfile.mkdtemp(prefix="maillode-"))
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once: whole texts, of which ten thousand are many MB.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block jobs send smaller batches to Python, unless the session's are small."""
    before = spark.conf.get(_ARROW_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def stored(frame: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame, written as a table to the shared folder and read again.

    ``options`` are those of the Parquet writer.

    Cuts the lineage: a lost executor costs the tasks that read the table, no more.
    """
    spark = frame.sparkSession
    path = shared_path(spark, label)
    with arrow_rows(spark, ARROW_ROWS):
        frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bits of the hash prefix in :func:`only_wanted`; a million prefixes of 8 bytes at most.
PREFIX_BITS = 20


def only_wanted(frame: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``frame`` whose ``key`` is in ``wanted``, which has that column.

    A wide ``frame`` is first thinned out, before its shuffle, by hash prefixes of the
    wanted keys. There are ``2 ** PREFIX_BITS`` prefixes, so their broadcast has a fixed
    bound; the more of them are in use, the less the first step saves. The second step is
    an exact join and decides.
    """
    prefix = F.shiftrightunsigned(F.xxhash64(key), 64 - PREFIX_BITS).alias("_prefix")
    wanted = wanted.select(key).distinct()
    prefixes = F.broadcast(wanted.select(prefix).distinct())
    near = frame.withColumn("_prefix", prefix).join(prefixes, "_prefix", "left_semi")
    return near.drop("_prefix").join(wanted, key, "left_semi")


def gapless_ranks(
    frame: DataFrame, group: str, spread_by: Sequence[str], order: Sequence[Column], n_rows: int
) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within each ``group``, in no particular order of rows.

    Rows are dealt to buckets by a hash of ``spread_by``, numbered within their bucket, and
    raised by the rows of the group in earlier buckets. A group of any size so takes part in
    all buckets, and no task sees it whole.
    """
    buckets = max(64, -(-n_rows // 100_000))
    dealt = frame.withColumn("_bucket", F.pmod(F.xxhash64(*spread_by), F.lit(buckets)))
    counts = dealt.groupBy("_bucket", group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = counts.select(
        "_bucket", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("_bucket", group).orderBy(*order)
    numbered = dealt.repartition("_bucket").withColumn("_number", F.row_number().over(within))
    return (
        numbered.join(base, ["_bucket", group])
        .withColumn("rank", F.col("_base") + F.col("_number") - 1)
        .drop("_bucket", "_number", "_base")
    )
