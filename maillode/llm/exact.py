"""Exact deduplication over counting quotient filters.

Every partition builds a counting quotient filter of its texts' fingerprints. A fingerprint
of 64 bits is split into the number of a block, a quotient and a remainder: a block holds the
run length of each of its quotients, the remainders of each run in order, and a counter for
each remainder. As runs are sorted and nothing is dropped, the blocks of all partitions merge
without loss. Fingerprints whose counter exceeds one go on to the verification of bytes; all
others are known to be single without their text ever being moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PREFIX_BITS, only_wanted, stored

#: A merged block holds about so many fingerprints.
BLOCK_FINGERPRINTS = 50_000
QUOTIENT_BITS = 6
_SLICE = "block long, runs binary, remainders binary, counters binary"


def build(fingerprints: np.ndarray, block_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The blocks of the filter of these unsigned 64-bit fingerprints."""
    values, counts = np.unique(fingerprints, return_counts=True)
    blocks = (values >> np.uint64(64 - block_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(values) else []
    rest_bits = np.uint64(64 - block_bits - QUOTIENT_BITS)
    rest_mask = (np.uint64(1) << rest_bits) - np.uint64(1)
    for start, end in zip(starts, [*starts[1:], len(values)], strict=True):
        part = values[start:end]
        quotients = (part >> rest_bits) & np.uint64((1 << QUOTIENT_BITS) - 1)
        runs = np.bincount(quotients.astype(np.int64), minlength=1 << QUOTIENT_BITS)
        yield (
            int(blocks[start]),
            runs.astype("<u4").tobytes(),
            (part & rest_mask).astype("<u8").tobytes(),
            counts[start:end].astype("<u8").tobytes(),
        )


def merge(
    block: int, slices: list[tuple[bytes, bytes, bytes]], block_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a block and their counters, added up over its slices, in order."""
    rest_bits = np.uint64(64 - block_bits - QUOTIENT_BITS)
    values, counters = [], []
    for runs, remainders, counts in slices:
        quotients = np.repeat(
            np.arange(1 << QUOTIENT_BITS, dtype=np.uint64), np.frombuffer(runs, "<u4")
        )
        values.append(quotients << rest_bits | np.frombuffer(remainders, "<u8"))
        counters.append(np.frombuffer(counts, "<u8"))
    joined, where = np.unique(np.concatenate(values), return_inverse=True)
    total = np.zeros(len(joined), np.uint64)
    np.add.at(total, where, np.concatenate(counters))
    return joined | np.uint64(block) << np.uint64(64 - block_bits), total


def repeated_fingerprints(frame: DataFrame, column: str) -> DataFrame:
    """Fingerprints (``column``, a long) that stand in more than one row, with ``copies``."""
    rows = frame.count()
    block_bits = min(40, max(6, (rows // BLOCK_FINGERPRINTS).bit_length()))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        if not seen:
            return
        for one in build(np.concatenate(seen).view(np.uint64), block_bits):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [one[0]],
                    "runs": pa.array([one[1]], pa.binary()),
                    "remainders": pa.array([one[2]], pa.binary()),
                    "counters": pa.array([one[3]], pa.binary()),
                }
            )

    def merged(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        values, counts = merge(
            int(key[0]),
            list(zip(part["runs"], part["remainders"], part["counters"], strict=True)),
            block_bits,
        )
        several = counts > 1
        return pd.DataFrame(
            {column: values[several].view(np.int64), "copies": counts[several].astype(np.int64)}
        )

    filters = frame.select(column).mapInArrow(slices, _SLICE)
    return filters.groupBy("block").applyInPandas(merged, f"{column} long, copies long")


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row
    with the largest id stays. Rows that repeat an id and its text are one document in so many
    rows: they count each in ``group_size`` and share one verdict. A null id loses against any
    other; rows with equal texts and null ids alone have a null ``keep_id`` and stay. Further
    columns are passed on, unless they bear the name of a result, which replaces them.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*results, "_fp", "_sha")
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("_fp", F.xxhash64(whole))
    repeated = stored(repeated_fingerprints(marked, "_fp"), "repeated")
    suspects = only_wanted(
        marked.select("_fp", F.col(doc_id).alias("_id"), whole.alias("_text")), repeated, "_fp"
    )
    # Grouping by the text itself compares bytes; copies fold before they are shuffled.
    equal = suspects.groupBy("_fp", "_text").agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    groups = equal.filter("group_size > 1").select(
        "_fp", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size"
    )
    own = F.col(doc_id)
    several = F.col("group_size").isNotNull()
    return (
        marked.withColumn("_sha", F.sha2(whole, 256))
        .join(groups, ["_fp", "_sha"], "left")
        .withColumn("keep_id", F.when(several, F.col("keep_id")).otherwise(own))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("kept", own.eqNullSafe(F.col("keep_id")))
        .withColumnRenamed("_sha", "text_sha256")
        .drop("_fp")
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of equal texts one row: a row of the document with the largest id, with its columns.

    Of rows that repeat this id and its text, the one that is last by its other columns stays.
    What goes is decided on ids and digests. Only rows whose digest may be among those that go
    are shuffled with their texts.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    marks = mark_copies(docs.select(F.col(doc_id).alias("_id"), text), "_id", text)
    times = marks.filter("group_size > 1").groupBy("_id", "text_sha256", "kept").agg(
        F.count("*").alias("_times")
    )
    times = stored(times.filter("NOT kept OR _times > 1"), "copies")
    keyed = docs.withColumn("_sha", digest)
    mark = F.shiftrightunsigned(F.xxhash64("_sha"), 64 - PREFIX_BITS)
    some = F.broadcast(
        times.select(F.shiftrightunsigned(F.xxhash64("text_sha256"), 64 - PREFIX_BITS).alias("_mark"))
        .distinct()
    )
    marked = keyed.withColumn("_mark", mark)
    alone = marked.join(some, "_mark", "left_anti").select(*docs.columns)
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256"))
    met = marked.join(some, "_mark", "left_semi").join(times, same, "left")
    others = met.filter("_id IS NULL AND text_sha256 IS NULL").select(*docs.columns)
    again = met.filter("kept AND _times > 1").groupBy("_sha")
    once = again.agg(F.max(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return alone.unionByName(others).unionByName(once)
