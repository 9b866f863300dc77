"""Sharding by histogram sort.

Rows are sorted by a key of two integers: the hash of the text, which keeps equal texts
together, and the id. The splitters between shards are found without sorting: every round
counts the exact bytes and rows below some probe keys in every partition, adds the counts up,
and puts the next probes between the two that enclose a wanted boundary. When all boundaries
are near enough, the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Bytes that one task sorts: a shard of more is cut into several ranges.
RANGE_BYTES = 256 << 20
#: Ranges in all, which bounds the probes of a round; beyond that, ranges grow.
MOST_RANGES = 16_384
#: A boundary may be off by this part of a shard.
TOLERANCE = 0.002
#: Probes between two known keys in a round.
PROBES = 8
_HALF = 1 << 63
_LOW, _HIGH = 0, (1 << 128) - 1


def _split(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & ((1 << 64) - 1)) - _HALF


def _joined(first: int, second: int) -> int:
    return (first + _HALF) << 64 | second + _HALF


def below(first: np.ndarray, second: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each probe, the rows of these sorted keys that lie below it."""
    pairs = [_split(probe) for probe in probes]
    high = np.array([pair[0] for pair in pairs], np.int64)
    left = np.searchsorted(first, high, "left")
    right = np.searchsorted(first, high, "right")
    for i in np.flatnonzero(right > left):
        left[i] += np.searchsorted(second[left[i] : right[i]], pairs[i][1], "left")
    return left


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The key, sorted, and the size of all rows of a partition."""
    table = pa.Table.from_batches(list(batches))
    first, second, size = (column.to_numpy() for column in table.columns)
    order = np.lexsort((second, first))
    return [first[order], second[order], size[order]]


def _counted(keys: DataFrame, probes: list[int]) -> dict[int, tuple]:
    """For the range from each probe to the next: rows, bytes, and its first and last key.

    A partition gives a row for each range in which it has any, so what is gathered has the
    size of ``probes``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        first, second, size = _columns(batches)
        edges = np.r_[below(first, second, probes), len(first)]
        total = np.r_[0, np.cumsum(size)]
        used = np.flatnonzero(edges[1:] > edges[:-1])
        starts, ends = edges[:-1][used], edges[1:][used]
        yield pa.RecordBatch.from_pydict(
            {
                "probe": used.astype(np.int32),
                "rows": ends - starts,
                "bytes": total[ends] - total[starts],
                "low_first": first[starts],
                "low_second": second[starts],
                "high_first": first[ends - 1],
                "high_second": second[ends - 1],
            }
        )

    counted = keys.select("_first", "_second", "_size").mapInArrow(
        count,
        "probe int, rows long, bytes long, low_first long, low_second long,"
        " high_first long, high_second long",
    )
    summed = counted.groupBy("probe").agg(
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.min(F.struct("low_first", "low_second")).alias("low"),
        F.max(F.struct("high_first", "high_second")).alias("high"),
    )
    return {row["probe"]: row for row in summed.collect()}


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """``parts - 1`` boundaries as (key, rows below it, bytes below it), in order."""
    whole = _counted(keys, [_LOW]).get(0)
    if whole is None:
        return [(_HIGH, 0, 0)] * (parts - 1)
    total, rows = whole["bytes"], whole["rows"]
    wanted = [total * j // parts for j in range(1, parts)]
    near = tolerance * total / parts
    start, end = _joined(*whole["low"]), _joined(*whole["high"]) + 1
    #: Each boundary lies between two keys, known with the rows and bytes below them.
    between = [((start, 0, 0), (end, rows, total))] * (parts - 1)
    while True:
        probes: set[int] = set()
        for (low, low_rows, low_bytes), (high, high_rows, high_bytes), want in (
            (*pair, want) for pair, want in zip(between, wanted, strict=True)
        ):
            if min(want - low_bytes, high_bytes - want) <= near or high_rows - low_rows <= 1:
                continue
            if high - low <= 1:
                continue
            step = max(1, (high - low) // (PROBES + 1))
            probes.update(range(low, high, step))
            probes.add(high)
        if not probes:
            break
        ordered = sorted(probes)
        counts = _counted(keys, [_LOW, *ordered])
        rows_below = bytes_below = 0
        points = []
        for i, probe in enumerate(ordered):
            if gone := counts.get(i):
                rows_below, bytes_below = rows_below + gone["rows"], bytes_below + gone["bytes"]
            points.append((probe, rows_below, bytes_below))
        at = [point[2] for point in points]
        for j, want in enumerate(wanted):
            low, high = between[j]
            i = int(np.searchsorted(at, want, "right")) - 1  # the last with no more below
            if i >= 0 and points[i][2] >= low[2]:
                # The next key that exists gives the same counts and a tighter range.
                if inside := counts.get(i + 1):
                    low = (_joined(*inside["low"]), *points[i][1:])
                    if i + 1 < len(points) and points[i + 1][2] <= high[2]:
                        above = min(points[i + 1][0], _joined(*inside["high"]) + 1)
                        high = (above, *points[i + 1][1:])
            between[j] = (low, high)
    return [
        min(pair, key=lambda point: abs(point[2] - want))
        for pair, want in zip(between, wanted, strict=True)
    ]


def whole_groups(
    keys: DataFrame, points: list[tuple[int, int, int]], wanted: list[int], most: int
) -> list[tuple[int, int, int]]:
    """These boundaries, each put on the nearer side of the group that it would cut.

    Groups of more than ``most`` bytes stay cut. One more count tells where the groups begin
    and end; a boundary moves within its own group, so the boundaries stay in order.
    """
    groups = sorted({key >> 64 for key, _, _ in points if key < _HIGH})
    probes = sorted({edge << 64 for group in groups for edge in (group, group + 1)})
    probes = [probe for probe in probes if probe <= _HIGH]
    if not probes:
        return points
    counts = _counted(keys, [_LOW, *probes])
    rows = size = 0
    at: dict[int, tuple[int, int, int]] = {}
    for i, probe in enumerate(probes):
        if gone := counts.get(i):
            rows, size = rows + gone["rows"], size + gone["bytes"]
        at[probe] = (probe, rows, size)
    out = []
    for point, want in zip(points, wanted, strict=True):
        start, end = (at.get(edge << 64) for edge in (point[0] >> 64, (point[0] >> 64) + 1))
        if start and end and start[1] < point[1] < end[1] and end[2] - start[2] <= most:
            point = min(start, end, key=lambda side: abs(side[2] - want))
        out.append(point)
    return out


def shard(
    frame: DataFrame,
    group: str,
    row_id: str,
    size: str,
    shards: int,
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1, near equal in bytes) and ``slot`` (0, 1, ... in it).

    Rows of one ``group`` (a long) stay in one shard; only a group of more bytes than a shard
    has is cut, by id. Shards may therefore differ by the size of the groups at their boundaries.
    A null group or id counts as the smallest one. Rows that agree in group and id can't be cut
    apart. Shards are empty when there are fewer groups than shards.

    A shard is sorted in ranges of ``range_bytes``, of which there are ``MOST_RANGES`` at most;
    that decides about the size of tasks alone.
    """
    smallest = F.lit(-_HALF)
    keyed = frame.drop("shard", "slot").withColumns(
        {
            "_first": F.coalesce(F.col(group), smallest),
            "_second": F.coalesce(F.col(row_id).cast("long"), smallest),
            "_size": F.coalesce(F.col(size).cast("long"), F.lit(0)),
        }
    )
    keys = stored(keyed.select("_first", "_second", "_size"), "keys")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    ranges = max(1, min(-(-total // (shards * range_bytes)), MOST_RANGES // shards))
    # Only the boundaries of shards need the tolerance; they are every so many of the ranges.
    found = find_splitters(keys, shards * ranges, tolerance * ranges)
    wanted = [total * j // shards for j in range(1, shards)]
    between = whole_groups(keys, found[ranges - 1 :: ranges], wanted, total // shards)
    edges = [(_LOW, 0, 0), *sorted({*found, *between})]
    splitters = [edge[0] for edge in edges[1:]]
    # A range belongs to the last shard that begins where the range does, or before.
    begins = [0, *(point[1] for point in between)]
    owner = [bisect_right([point[0] for point in between], edge[0]) for edge in edges]
    base = [edge[1] - begins[own] for edge, own in zip(edges, owner, strict=True)]

    @F.pandas_udf("int")
    def range_of(first, second):
        import pandas as pd

        # Rows below which splitters: the position after the last splitter not above the key.
        out = np.empty(len(first), np.int32)
        f, s = first.to_numpy(), second.to_numpy()
        order = np.lexsort((s, f))
        starts = below(f[order], s[order], splitters)
        out[order] = np.searchsorted(starts, np.arange(len(f)), "right")
        return pd.Series(out)

    placed = keyed.withColumn("_range", range_of("_first", "_second"))
    within = Window.partitionBy("_range").orderBy("_first", "_second")
    offset = F.element_at(F.array(*map(F.lit, base)), F.col("_range") + 1)
    return (
        placed.withColumn("_number", F.row_number().over(within) - 1)
        .withColumn("shard", F.element_at(F.array(*map(F.lit, owner)), F.col("_range") + 1))
        .withColumn("slot", (F.col("_number") + offset).cast("long"))
        .drop("_first", "_second", "_size", "_range", "_number")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows as Parquet, a directory for each shard, in the order of their slots."""
    ordered = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
