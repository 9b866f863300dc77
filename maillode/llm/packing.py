"""Best-fit packing of token sequences, in bulk-synchronous steps.

Pieces of one length are alike, and so are sequences with one gap. The sorted documents and
gaps are therefore held as runs: a length with its number of pieces, a gap with its range of
sequences. In every superstep each piece class, from the longest down, asks its successors,
the narrowest gaps that still hold it; where more pieces want a gap class than it has
sequences, those with the lower ranks get it and the others go on to the next wider class.
Then all gaps are updated at once and the next step begins. Runs are bounded by the lengths
there are (at most the capacity), not by the documents, so a step costs next to nothing, and
the pieces themselves move once: they are ranked within their length over all partitions, and
the rank says which run, sequence and place is theirs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gapless_ranks, stored
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
#: A step takes up pieces whose lengths differ by this factor at most.
STEP = 1.02
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """The pieces of all whole texts: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if wanted, ``ids`` (packed little-endian unsigned 32-bit).

    A null or empty text is the end id alone. Of a document longer than ``capacity`` all
    pieces are full, but for the first.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).batch
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for number, ids in _encoded(batch, encode):
                ids += end
                total = len(ids) // 4
                edge, start, piece = (total - 1) % capacity + 1, 0, 0
                while start < total:
                    part = ids[start * 4 : edge * 4]
                    row = (number, piece, start, edge - start, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
                    piece, start, edge = piece + 1, edge, edge + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds[: len(names)], strict=True)], names
            )

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def _encoded(batch: pa.RecordBatch, encode: Callable) -> Iterator[tuple[int | None, bytes]]:
    for start in range(0, len(batch), 256):
        part = batch.slice(start, 256)
        ids = encode(part["text"].to_pylist())
        yield from zip(part["doc_id"].to_pylist(), ids, strict=True)


def best_fit_runs(classes: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces go, as runs (length, first rank, pieces, first sequence, offset).

    ``classes``: how many pieces there are of each length. The pieces of a run lie in as many
    sequences one after the other, each at ``offset``.
    """
    left = {length: n for length, n in sorted(classes.items(), reverse=True) if n}
    ranks: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of sequences
    opened = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], n, first, offset))
        ranks[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        gaps[capacity - offset - length].append((first, n))

    while left:
        # Pieces that no gap holds open sequences, at once as many as their tokens fill.
        widest = max((gap for gap, ranges in gaps.items() if ranges), default=0)
        longest = max(left)
        if longest > widest:
            mass = sum(length * n for length, n in left.items())
            room = sum(gap * n for gap, ranges in gaps.items() for _, n in ranges)
            need = max(1, -(-(mass - room) // capacity))
            for length in sorted(left, reverse=True):
                if length <= widest or STEP * length < longest:
                    break
                if need <= 0 and 2 * length <= capacity:
                    break
                n = left[length] if 2 * length > capacity else min(left[length], need)
                place(length, n, opened, 0)
                opened, need = opened + n, need - n
        # A step: the sequences that were open at its start take a piece at most. Clearly
        # shorter pieces than the longest wait, so that long ones are placed first.
        open_gaps = sorted(gap for gap, ranges in gaps.items() if gap and ranges)
        before = {gap: gaps.pop(gap) for gap in open_gaps}
        longest = max(left, default=0)
        for length in sorted(left, reverse=True):
            if STEP * length < longest:
                break
            at = bisect_left(open_gaps, length)
            while at < len(open_gaps) and length in left:
                ranges = before[open_gaps[at]]
                while ranges and length in left:
                    first, n = ranges.pop()
                    taken = min(n, left[length])
                    place(length, taken, first, capacity - open_gaps[at])
                    if n > taken:
                        ranges.append((first + taken, n - taken))
                at += 1
        for gap, ranges in before.items():
            gaps[gap].extend(ranges)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``length`` must be from 1 to ``capacity``.

    Every row is placed, repeated ones too; columns named as the results are replaced. Rows
    of one length are interchangeable: which of them gets which place follows from a hash of
    their ``doc_id`` and ``piece``.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counted = pieces.groupBy("length").count().collect()  # one row a length: at most capacity
    classes = {row["length"]: row["count"] for row in counted}
    runs = best_fit_runs(classes, capacity)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = gapless_ranks(pieces, "length", ["doc_id", "piece"], order, sum(classes.values()))
    starts = (runs[:, 0] << 44) | runs[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((starts, runs))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, runs = sent.value
        wanted = (length.to_numpy() << 44) | rank.to_numpy()
        at = np.searchsorted(starts, wanted, "right") - 1
        run = runs[at]
        return pd.DataFrame(
            {"sequence_id": run[:, 3] + rank.to_numpy() - run[:, 1], "offset": run[:, 4]}
        )

    placed = ranked.withColumn("_place", place("length", "rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack; the pieces are stored in between, so that texts are encoded once."""
    return pack(stored(cut_pieces(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of the whole sequence, from packed pieces with ids."""
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda part: part["ids"]
    )
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
