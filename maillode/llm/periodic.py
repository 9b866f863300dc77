"""Runs of periodically repeated words, by longest common extensions on suffix trees.

A run's words lie in stretches where every word sequence of eight comes up again in the text,
since a run of three periods and 24 words holds each of its sequences of eight once more, a
period before or after. Each such stretch (all else can't hold a run) gets a suffix tree and one
of its reversal, both by Ukkonen's construction. Euler tours over them answer in constant time
how far two positions agree, forwards and backwards. The longest Lyndon word at each position,
for the words' order and for its opposite, is a candidate for a run's root: every run has one of
them. Extended in both directions, it is a run if it becomes long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import no_collections

#: A run has so many words at least, and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Length of the word sequences that have to come up again. With 24 words and three periods,
#: no longer sequence is sure to: 24 - 8 is the last period's reach, 2 * 8 at most.
GRAM = 8
#: Bytes of text that go to the JVM at once, as far as whole documents allow.
SENT = 4_000_000
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_tree(word: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's suffix tree of ``word``, whose last letter occurs once only.

    For each node its children by their first letter, and the ends of the edge that leads to it.
    """
    end = len(word)
    leaf: dict[int, int] = {}  # one for all leaves
    children: list[dict[int, int]] = [{}]
    first, last, link = [0], [0], [0]
    node = length = at = waiting = 0  # the active point: node, letters below it, their place
    for i, letter in enumerate(word):
        waiting += 1
        inner = 0  # the node of this phase that still wants its suffix link
        while waiting:
            if not length:
                at = i
            child = children[node].get(word[at])
            if child is None:
                children[node][word[at]] = len(first)
                children.append(leaf)
                first.append(i)
                last.append(end)
                link.append(0)
                if inner:
                    link[inner] = node
                inner = node
            else:
                width = last[child] - first[child]
                if last[child] == end:
                    width = i + 1 - first[child]
                if length >= width:
                    node, length, at = child, length - width, at + width
                    continue
                if word[first[child] + length] == letter:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                split = len(first)
                start = first[child]
                children[node][word[at]] = split
                children.append({word[start + length]: child, letter: split + 1})
                children.append(leaf)
                first += [start, i]
                last += [start + length, end]
                link += [0, 0]
                first[child] = start + length
                if inner:
                    link[inner] = split
                inner = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return children, first, last


class Extensions:
    """How far two suffixes of a word agree, and the suffixes' ranks in both orders of letters.

    The Euler tour notes the depth of the node after each step. The suffixes' longest common
    prefix is the least depth between their leaves, which blocks of the tour answer: sparse
    tables over the blocks' minima, running minima inside them.
    """

    BLOCK = 16

    def __init__(self, word: list[int]):
        n = len(word)
        children, first, last = suffix_tree([*word, -1])
        tour: list[int] = []
        leaf_at = [0] * (n + 1)
        self.rank = [0] * (n + 1)
        self.opposite_rank = [0] * (n + 1)
        # In the tour children stand in the order of their letters, the end of the word first.
        path: list[tuple[int, Iterator[int]]] = [(0, self._ordered(children[0]))]
        tour.append(0)
        seen = 0
        while path:
            depth, rest = path[-1]
            child = next(rest, -1)
            if child < 0:
                path.pop()
                if path:
                    tour.append(path[-1][0])
                continue
            below = depth + last[child] - first[child]
            if children[child]:
                tour.append(below)
                path.append((below, self._ordered(children[child])))
                continue
            suffix = n + 1 - below
            leaf_at[suffix] = len(tour)
            tour.append(below)
            tour.append(depth)
            self.rank[suffix] = seen
            seen += 1
        self._rank_opposite(n, children, first, last)
        self.leaf_at = np.array(leaf_at, np.int64)
        self._prepare(np.array(tour, np.int32))

    @staticmethod
    def _ordered(children: dict[int, int]) -> Iterator[int]:
        return iter([children[letter] for letter in sorted(children)])

    def _rank_opposite(
        self, n: int, children: list[dict[int, int]], first: list[int], last: list[int]
    ) -> None:
        """Ranks when greater letters come first and the end of the word still before all."""
        seen = 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            own = children[node]
            if not own:
                self.opposite_rank[n + 1 - depth] = seen
                seen += 1
                continue
            for letter in sorted(own):  # the last put on the stack is the first taken
                if letter >= 0:
                    stack.append((own[letter], depth + last[own[letter]] - first[own[letter]]))
            if -1 in own:
                stack.append((own[-1], depth + last[own[-1]] - first[own[-1]]))

    def _prepare(self, tour: np.ndarray) -> None:
        size = self.BLOCK
        blocks = -(-len(tour) // size)
        padded = np.full(blocks * size, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = tour
        square = padded.reshape(blocks, size)
        self.tour = padded
        self.from_start = np.minimum.accumulate(square, axis=1).ravel()
        self.to_end = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.sparse = [square.min(axis=1)]
        while 2 << (len(self.sparse) - 1) <= blocks:
            half, below = 1 << (len(self.sparse) - 1), self.sparse[-1]
            self.sparse.append(np.minimum(below[:-half], below[half:]))

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each two different suffixes."""
        a, b = self.leaf_at[left], self.leaf_at[right]
        a, b = np.minimum(a, b), np.maximum(a, b)
        size = self.BLOCK
        block_a, block_b = a // size, b // size
        least = np.minimum(self.to_end[a], self.from_start[b])
        near = block_a == block_b
        if near.any():
            inside = self.tour[a[near]]
            for step in range(1, size):
                inside = np.minimum(inside, self.tour[np.minimum(a[near] + step, b[near])])
            least[near] = inside
        far = block_b - block_a > 1
        if far.any():
            start, count = block_a[far] + 1, block_b[far] - block_a[far] - 1
            level = np.frexp(count)[1] - 1  # the largest power of two that isn't more
            between = np.empty(len(count), np.int32)
            for k in np.unique(level):
                now = level == k
                table = self.sparse[k]
                end = start[now] + count[now] - (1 << int(k))
                between[now] = np.minimum(table[start[now]], table[end])
            least[far] = np.minimum(least[far], between)
        return least.astype(np.int64)


def _lyndon_ends(rank: list[int], n: int) -> np.ndarray:
    """Where the longest Lyndon word from each position ends: at the next smaller suffix."""
    ends = [n] * n
    open_: list[int] = []
    for i in range(n):
        own = rank[i]
        while open_ and rank[open_[-1]] > own:
            ends[open_.pop()] = i
        open_.append(i)
    return np.array(ends, np.int64)


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of ``word`` (letters from 0), in order."""
    n = len(word)
    if n < LEAST_WORDS:
        return []
    ahead = Extensions(word)
    starts = np.arange(n, dtype=np.int64)
    ends = [_lyndon_ends(ranks, n) for ranks in (ahead.rank, ahead.opposite_rank)]
    roots = np.unique(np.concatenate([starts * (n + 1) + end for end in ends]))
    begin, end = roots // (n + 1), roots % (n + 1)
    after = np.zeros(len(roots), np.int64)
    inside = end < n
    after[inside] = ahead.common(begin[inside], end[inside])
    del ahead
    period = end - begin
    back = Extensions(word[::-1])
    before = np.zeros(len(roots), np.int64)
    some = begin > 0
    before[some] = back.common(n - begin[some], n - end[some])
    length = before + period + after
    enough = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
    found = {
        (int(s), int(size), int(p))
        for s, size, p in zip(
            (begin - before)[enough], length[enough], period[enough], strict=True
        )
    }
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where a run may be: begin and end of each stretch of repeated word sequences.

    Equal sequences have equal hashes; others that share one by chance only make a stretch
    longer.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
        grams += hashes[k : n - GRAM + 1 + k]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(grams) + 2, np.int8)
    again[1:-1][order[1:][same]] = 1
    again[1:-1][order[:-1][same]] = 1
    steps = np.diff(again)
    begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    long_enough = ends - begins >= LEAST_WORDS - GRAM + 1
    return [
        (int(b), int(e) + GRAM - 1)
        for b, e in zip(begins[long_enough], ends[long_enough], strict=True)
    ]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of ``words``, by start, then period."""
    found = []
    for begin, end in stretches(words):
        letters: dict[bytes, int] = {}
        numbered = [letters.setdefault(word, len(letters)) for word in words[begin:end]]
        found += [(begin + start, size, p) for start, size, p in runs_of(numbered)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def edited_words(words: list[bytes], crc: int) -> list[bytes]:
    """The words with a periodic end put in, where the document's number asks for one."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(steps)[:-1] == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edited: bool = False
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``runs`` (an array of ``start``,
    ``length``, ``period`` in words, by start, then period) and ``collapsed``, the text's words
    without those that a run repeats after its first period, one space between them.

    Words are what ASCII white space separates. A null or empty text has no words and no runs.
    With ``edited`` the words first get the periodic ends that the id's checksum asks for; a
    null id asks for none. Further columns are not passed on; repeated rows are rows like any
    other. A text is handled whole by one task; a stretch of repeated word sequences takes about
    a kilobyte a word while its trees stand, all other words a few dozen bytes.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {id_type}, n_words long, runs array<{_RUN}>, collapsed string"
    crc = F.crc32(F.col(doc_id).cast("string")) if edited else F.lit(None).cast("long")
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def one(text: str | None, crc: int | None) -> tuple[int, list[dict], bytes]:
        words = (text or "").encode().split()  # bytes split at ASCII white space only
        if crc is not None:
            words = edited_words(words, crc)
        runs = word_runs(words)
        named = [{"start": s, "length": size, "period": p} for s, size, p in runs]
        return len(words), named, collapsed(words, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, crcs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            start = 0
            while start < len(texts):
                rows: list = []
                size, at = 0, start
                with no_collections():
                    while at < len(texts) and (size < SENT or at == start):
                        rows.append(one(texts[at], crcs[at]))
                        size += len(rows[-1][2])
                        at += 1
                n_words, runs, left = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, at - start), pa.array(n_words, pa.int64()),
                        pa.array(runs, pa.list_(run_type)),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    [doc_id, "n_words", "runs", "collapsed"],
                )
                start = at

    return docs.select(doc_id, text, crc.alias("crc")).mapInArrow(run, schema)


def _more_periodic(one: Column, other: Column) -> Column:
    """Whether ``one`` goes before ``other``: more periods, then start, then period."""
    left, right = one["length"] * other["period"], other["length"] * one["period"]
    sooner = (one["start"] < other["start"]) | (
        (one["start"] == other["start"]) & (one["period"] < other["period"])
    )
    return (left > right) | ((left == right) & sooner)


def describe_runs(found: DataFrame) -> DataFrame:
    """The rows of :func:`find_runs` with ``n_runs``, the most periodic run's ``start``,
    ``length``, ``period`` and ``exponent_milli`` (null without runs), and the digests
    ``runs_sha256`` and ``collapsed_sha256``."""
    best = F.reduce(
        "runs", F.lit(None).cast(_RUN),
        lambda top, run: F.when(top.isNull() | _more_periodic(run, top), run).otherwise(top),
    )
    lines = F.transform(
        "runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    )
    return (
        found.withColumn("_best", best)
        .withColumn("n_runs", F.size("runs").cast("long"))
        .withColumn("start", F.col("_best.start"))
        .withColumn("length", F.col("_best.length"))
        .withColumn("period", F.col("_best.period"))
        .withColumn("exponent_milli", F.expr("1000 * length div period"))
        .withColumn(
            "runs_sha256",
            F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256),
        )
        .withColumn("collapsed_sha256", F.sha2("collapsed", 256))
        .drop("_best")
    )
