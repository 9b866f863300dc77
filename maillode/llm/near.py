"""Near-duplicate documents: banded MinHash, candidates thinned by odd sketches, links
confirmed on full sets.

Of each document's set of five-word shingles, one scan makes MinHash samples, band keys, and
an odd sketch: every sample flips one bit of a bitmap, so that the exclusive or of two bitmaps
has a bit for each sample in which they differ, and few of them for similar sets. Documents
with equal sets are one class from there on.

No pairs of a whole bucket are made. First every class is compared with the smallest id of
each of its buckets, and the links found are joined to components. Where more than one component
is left in a bucket, its members are compared in a few blocks, inside tasks. Those of larger
buckets go through a prefix filter on their full sets first: in an order that puts shingles of a
single component first, and rare ones before frequent ones, two sets that are similar enough
share one of their first shingles. Most look-alikes that are no links have too many shingles of
their own for that, and only what still shares a shingle is compared. No link that a band shows
is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import only_wanted, stored

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair of similarity 0.75 meets in no band once in 200,000 times, 0.8 once in 10 million.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Most bits in which the sketches of a candidate may differ: what similarity 0.5 gives on
#: average, and 0.75 in 3 of a million pairs.
MOST_BITS = 100
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Blocks of a bucket that are compared with each other, so that a member is in as many rows at
#: most; larger buckets go through the prefix filter.
MOST_BLOCKS = 8
#: Bytes of text that are hashed at once, if a document isn't longer.
HASH_BYTES = 1 << 18

_draw = np.random.default_rng(20_240_601)
_BYTE = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SKETCHES = (
    "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of 64-bit shingle hashes of each text, in order."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        one = text.encode("utf-8", "surrogatepass").lower() if text else b""  # A-Z only
        if held and size + len(one) > HASH_BYTES:
            yield from _hashed(held)
            held, size = [], 0
        held.append(one)
        size += len(one) + 1
    yield from _hashed(held)


def _hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(before & ~inside)  # the space after each word
    # Words with one space after each, and a polynomial hash of every prefix.
    kept = inside | (before & ~inside)
    place = np.cumsum(kept) - 1
    letters = np.where(inside, data, 32)[kept]
    powers = np.cumprod(np.full(len(letters), _STEP))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[letters] * powers)]
    inverse = np.cumprod(np.full(len(letters), _UNSTEP))
    starts, ends = place[starts], place[ends]
    edges = np.r_[0, np.cumsum(kept)][np.cumsum([len(t) + 1 for t in texts])]
    counts = np.diff(np.r_[0, np.searchsorted(starts, edges, "left")])
    first = np.cumsum(counts) - counts
    shingles = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    offsets = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    within = np.arange(total) - np.repeat(offsets, shingles)
    begin = np.repeat(first, shingles) + within
    last = begin + np.repeat(np.minimum(counts, WIDTH), shingles) - 1
    spans = (sums[ends[last]] - sums[starts[begin]]) * inverse[starts[begin]] if total else sums[:0]
    hashes = mixed(spans)
    for offset, n in zip(offsets.tolist(), shingles.tolist(), strict=True):
        yield np.unique(hashes[offset : offset + n])


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches (as longs) of sets that aren't empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    samples = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        samples[:, k] = np.minimum.reduceat(joined * _FACTORS[k], starts)
    # Samples of different number must not agree by chance of value alone.
    samples = mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * _STEP)
    bits = (samples >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    flat = (np.arange(len(sets))[:, None] * SKETCH_BITS + bits).ravel()
    odd = np.bincount(flat, minlength=len(sets) * SKETCH_BITS).astype(np.uint8) & 1
    sketch = np.packbits(odd.reshape(len(sets), SKETCH_BITS), axis=1).view(np.int64)
    rows = samples.reshape(len(sets), BANDS, ROWS)
    keys = rows[:, :, 0]
    for r in range(1, ROWS):
        keys = mixed(keys * np.uint64(3) + rows[:, :, r])
    return keys.view(np.int64), sketch


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    edges = np.arange(0, values.size + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(edges, pa.array(values.ravel()))


def sketched(docs: DataFrame) -> DataFrame:
    """``SKETCHES`` of every row with an id and a word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                sets = list(shingle_sets(part["text"].to_pylist()))
                used = [i for i, one in enumerate(sets) if len(one)]
                if not used:
                    continue
                sets = [sets[i] for i in used]
                keys, odd = signatures(sets)
                hashes = np.array(
                    [(one.sum(), np.bitwise_xor.reduce(mixed(one + _STEP))) for one in sets]
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[used].astype(np.int64)),
                        pa.array([len(one) for one in sets], pa.int64()),
                        pa.array(hashes[:, 0]), pa.array(hashes[:, 1]),
                        _lists(keys), _lists(odd),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"],
                )

    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(sketch, SKETCHES)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id``, ``set_id`` and ``shingles``, the packed sorted set, of the documents in ``ids``.

    ``set_id``, a hash of the set, tells the texts of an id apart.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = list(shingle_sets(part["text"].to_pylist()))
                hashes = [np.bitwise_xor.reduce(mixed(one)).view(np.int64) for one in found]
                packed = [one.tobytes() for one in found]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(hashes, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "set_id", "shingles"],
                )

    texts = only_wanted(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id")
    return stored(texts.mapInArrow(sets, "doc_id long, set_id long, shingles binary"), "sets")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def confirmed(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the candidate pairs (``a``, ``b``), those whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The sets are looked at where Arrow has them, without copies.
            sides = [
                [np.frombuffer(one.as_buffer(), np.uint64) for one in batch[side]]
                for side in ("x", "y")
            ]
            found = [linked(x, y) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    left = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(similar, "a long, b long")


def _differing(x: str, y: str):
    return F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n
    )


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that sizes and odd sketches don't rule out."""
    facts = lambda side, n, odd: classes.select(
        F.col("doc_id").alias(side), F.col("n_shingles").alias(n), F.col("odd").alias(odd)
    )
    near = pairs.join(facts("a", "_m", "_x"), "a").join(facts("b", "_n", "_y"), "b")
    sizes = 100 * F.least("_m", "_n") >= PERCENT * F.greatest("_m", "_n")
    return near.filter(sizes & (_differing("_x", "_y") <= MOST_BITS)).select("a", "b").distinct()


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """A row for each shingle of (doc_id, component, set_id, shingles); ``n`` is the set's size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = [np.frombuffer(one.as_buffer(), np.uint64) for one in part["shingles"]]
                sizes = np.array([len(one) for one in sets])
                repeated = [
                    pa.array(np.repeat(part[name].to_numpy(), sizes))
                    for name in ("doc_id", "component", "set_id")
                ]
                keys = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*repeated, pa.array(np.repeat(sizes, sizes)), pa.array(keys)],
                    ["doc_id", "component", "set_id", "n", "key"],
                )

    return sets.mapInArrow(rows, "doc_id long, component long, set_id long, n long, key long")


def _open(rows: DataFrame) -> DataFrame:
    """The keys that rows of more than one component have, and how many rows have them."""
    groups = rows.groupBy("key").agg(
        F.count("*").alias("holders"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    )
    return groups.filter("low <> high").select("key", "holders")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(doc_id, component, key): the first shingles of each set, of those in several components.

    Similar sets share PERCENT of the larger one's shingles at least, so in one order of all
    shingles they share one of the first ``n`` minus that many, plus one. Shingles of a single
    component stand at the front of the order and need no row, as no partner is found by them.
    """
    by_set = Window.partitionBy("doc_id", "set_id")
    needed = F.ceil(F.col("n") * PERCENT / 100)
    shared = rows.join(_open(rows), "key").withColumn(
        "nth", F.row_number().over(by_set.orderBy("holders", "key"))
    )
    first = shared.withColumn("n_shared", F.count("*").over(by_set)).filter(
        F.col("nth") <= F.col("n_shared") - needed + 1
    )
    return first.select("doc_id", "component", "key")


def _across(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Links between components of classes that share a bucket; none with a bucket's first.

    Members of a bucket meet in few blocks, those of larger buckets by their first shingles. A first pass over the sketches tells which members have a partner that looks
    alike; only these get their full sets, and the second pass confirms. Of a block's links, as
    many are given as join its components.
    """
    known = found.select(F.col("node").alias("doc_id"), "component")
    placed = classes.join(known, "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    members = placed.select("doc_id", "component", F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min("doc_id").alias("pivot"))
    open_ones = _open(members).filter("holders > 2").join(pivots, "key")
    # Buckets with the same smallest id mostly have the same members: they are one group.
    grouped = members.join(open_ones.select("key", "pivot"), "key").filter("doc_id <> pivot")
    grouped = stored(
        grouped.select("doc_id", "component", F.col("pivot").alias("key")).distinct(), "grouped"
    )
    inside = grouped.join(_open(grouped), "key")
    large = inside.filter(F.col("holders") > BLOCK * MOST_BLOCKS)
    several = large.select("doc_id", "component").distinct()
    once = full_sets(docs, several).join(several, "doc_id").dropDuplicates(["doc_id", "set_id"])
    prefixes = stored(_prefixes(_shingle_rows(once)), "prefixes")
    dealt = _in_blocks(inside.filter(F.col("holders") <= BLOCK * MOST_BLOCKS)).unionByName(
        _in_blocks(prefixes.join(_open(prefixes), "key"))
    )
    facts = classes.select("doc_id", "n_shingles", "odd")
    alike = stored(_by_block(dealt.join(facts, "doc_id"), _alike_members, dealt.schema), "alike")
    full = full_sets(docs, alike).drop("set_id")
    rows = alike.join(facts, "doc_id").join(full, "doc_id")
    return _by_block(rows, _block_links, T.StructType.fromDDL("a long, b long")).distinct()


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a key with ``holders`` dealt to pairs of blocks, one pair where they are few."""
    blocks = F.ceil(F.col("holders") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "doc_id", "component", "key", "own",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )


BLOCK_OF = ["key", "i", "j"]


def _by_block(rows: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """``work`` on all rows of each block pair of a key, of bounded number."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            names = frame[BLOCK_OF].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            for start, end in zip(edges, edges[1:], strict=False):
                yield from work(frame.iloc[start:end])
            held = frame.iloc[edges[-1] :]
        if held is not None:
            yield from work(held)

    dealt = rows.repartition(*BLOCK_OF).sortWithinPartitions(*BLOCK_OF)
    return dealt.mapInArrow(stage, schema)


def _block_pairs(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """A row, and the rows of other components that look like it."""
    i, j = (int(part[c].iloc[0]) for c in ("i", "j"))
    ids, component = part["doc_id"].to_numpy(), part["component"].to_numpy()
    if component.min() == component.max():
        return
    sizes, own = part["n_shingles"].to_numpy(), part["own"].to_numpy()
    odd = np.stack(part["odd"].to_list()).view(np.uint64)
    right = np.flatnonzero(own == j)
    for x in np.flatnonzero(own == i).tolist():
        near = right[(component[right] != component[x]) & ((ids[right] > ids[x]) | (i != j))]
        if not len(near):
            continue
        low, high = np.minimum(sizes[near], sizes[x]), np.maximum(sizes[near], sizes[x])
        near = near[100 * low >= PERCENT * high]
        near = near[np.bitwise_count(odd[near] ^ odd[x]).sum(axis=1) <= MOST_BITS]
        if len(near):
            yield x, near


def _alike_members(part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    some = np.zeros(len(part), bool)
    for x, near in _block_pairs(part):
        some[x] = some[near] = True
    if some.any():
        names = ["doc_id", "component", "key", "own", "i", "j"]
        yield pa.RecordBatch.from_pandas(part.loc[some, names], preserve_index=False)


def _block_links(part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    ids, label = part["doc_id"].to_numpy(), part["component"].to_numpy().copy()
    sets = [np.frombuffer(one, np.uint64) for one in part["shingles"]]
    a: list[int] = []
    b: list[int] = []
    for x, near in _block_pairs(part):
        for y in near.tolist():
            if label[x] != label[y] and linked(sets[x], sets[y]):
                label[label == label[y]] = label[x]
                a.append(min(ids[x], ids[y]))
                b.append(max(ids[x], ids[y]))
    if a:
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
        )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Words are what stands between ASCII white space, after A-Z are lower-cased. A text of one
    to four words is one shingle; one without words has none and is linked with nothing. Rows
    that repeat an id are one document, with the links of all its texts (and the least of their
    sizes), and all have its result; a row without an id is linked
    with nothing, has a null ``component_id`` and is kept. Other columns are ignored.
    """
    sketches = stored(sketched(docs), "sketches")
    same = ["set_a", "set_b", "n_shingles"]
    first = stored(sketches.groupBy(*same).agg(F.min("doc_id").alias("class_id")), "first")
    members = sketches.select("doc_id", *same).join(first, same).select(
        "doc_id", "n_shingles", "class_id"
    )
    members = stored(members, "members")
    heads = members.filter("doc_id = class_id").select("doc_id").distinct()
    # An id with several texts keeps all of them: its links are those of any of its texts.
    classes = sketches.join(heads, "doc_id").dropDuplicates(["doc_id", *same]).drop(*same[:2])
    classes = stored(classes, "classes")

    exploded = classes.select("doc_id", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n"))
    stars = exploded.join(buckets.filter("n > 1").select("key", "a"), "key")
    stars = stars.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    pairs = stored(_alike(stars, classes), "stars")
    links = confirmed(full_sets(docs, ends(pairs)), pairs).distinct()
    least = members.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    same_id = members.select("doc_id", F.col("class_id").alias("b")).join(least, "doc_id")
    same_id = same_id.filter("a <> b").select("a", "b").distinct()
    links = stored(links.unionByName(same_id), "confirmed")
    found = components(links, "a", "b")
    more = stored(_across(docs, classes, found), "across")
    if not more.isEmpty():
        found = components(links.unionByName(more), "a", "b")

    known = found.select(F.col("node").alias("class_id"), F.col("component"))
    joined = members.join(known, "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")
    )
    ids = docs.select(F.col("doc_id").cast("long"))
    # Rows that repeat an id agree, so any of them will do.
    repeated = joined.groupBy("doc_id").agg(
        F.min("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    )
    return ids.join(repeated, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    gone = near_duplicates(docs).filter("NOT kept")
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
