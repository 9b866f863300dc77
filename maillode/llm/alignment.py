"""Alignment of two tokenizers' tokens on the bytes of each text.

A byte-level BPE (A) and a piece BPE with byte fallback (B) cut the same bytes differently.
Where tokens of both end at the same byte, a group ends. An array made beforehand maps each id
of A to the id of B with the same bytes: links between such twins, which is all there is in a
group of one token on each side, are counted in vectors as long as A's vocabulary. Only the
other links, those of irregular groups, are counted by shuffling pairs of ids.

Neither tokenizer merges across a space that follows something else, so every text is cut
there, and each distinct piece is encoded and aligned once in a worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lasting, no_collections, stored
from .tokens import BulkEncoder

#: Pieces remembered by a worker process, and the longest of them in characters (some 400 bytes
#: each); others are aligned whenever they come up.
REMEMBERED = 300_000
LONGEST = 40
#: Pairs at most whose counts every worker gets (16 bytes each); the others' are joined.
SHIPPED = 1 << 20
#: Distinct pairs that a task adds up before it passes them on.
HELD = 2_000_000
#: Bytes of group texts that go to the JVM at once, as far as whole documents allow.
SENT = 4_000_000
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_RISKY = re.compile(r" (?:\s|$)")
_ALIGNED = (
    "row long, {id} {type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "codes binary, times binary"
)


class Aligner:
    """The two tokenizers, their tokens' bytes, and what is known of pieces."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = BulkEncoder(a_path)
        self.a = encoder.tokenizer
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_sign = {chr(byte): byte for byte in range(256) if byte not in encoder.shown}
        of_sign |= {chr(sign): byte for byte, sign in encoder.shown.items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.a_bytes[number] = bytes(map(of_sign.__getitem__, token))
        self.n_b = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else
            piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.n_b))
        ]
        self.twin_codes = self._twins()
        self.known: dict[str, tuple[bytes, bytes, bytes] | None] = {}

    def _twins(self) -> np.ndarray:
        """For each id of A the code of its link to the id of B with the same bytes, else -1.

        A byte may be a token of B in two ways; the one that isn't a fallback is taken.
        """
        ids: dict[bytes, int] = {}
        for i, own in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (
                own not in ids or self.b.is_byte(ids[own])
            ):
                ids[own] = i
        return np.array(
            [a * self.n_b + ids[own] if own in ids else -1 for a, own in enumerate(self.a_bytes)],
            np.int64,
        )

    def _align(
        self, whole: bytes, a_ids: list[int], b_ids: list[int]
    ) -> tuple[bytes, bytes, bytes] | None:
        """Groups as text, codes of all links, and the numbers of tokens and groups.

        Each piece between neighbouring ends of either side is one pair of tokens that overlap,
        and each such pair is one such piece. None where the tokens' bytes are not the text's.
        """
        a_own = [self.a_bytes[i] for i in a_ids]
        b_own = [self.b_bytes[i] for i in b_ids]
        if b"".join(a_own) != whole or b"".join(b_own) != whole:
            return None
        links, groups, n_b = [], [], self.n_b
        i = j = a_from = b_from = a_end = b_end = 0
        if a_ids:
            a_end, b_end = len(a_own[0]), len(b_own[0])
        while i < len(a_ids):
            links.append(a_ids[i] * n_b + b_ids[j])
            step_a, step_b = a_end <= b_end, b_end <= a_end
            if step_a and step_b:
                left = ",".join(map(str, a_ids[a_from : i + 1]))
                groups.append(f"{left}|{','.join(map(str, b_ids[b_from : j + 1]))}")
                a_from, b_from = i + 1, j + 1
            if step_a:
                i += 1
                a_end += len(a_own[i]) if i < len(a_ids) else 0
            if step_b:
                j += 1
                b_end += len(b_own[j]) if j < len(b_ids) else 0
        return (
            ";".join(groups).encode(),
            np.array(links, "<i8").tobytes(),
            np.array([len(a_ids), len(b_ids), len(groups)], "<i8").tobytes(),
        )

    def _learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes, bytes] | None]:
        after_space = [f" {piece}" for piece in pieces]
        a = self.a.encode_batch_fast(after_space, add_special_tokens=False)
        b = self.b.encode(pieces, num_threads=1)  # puts the space before them itself
        return {
            piece: self._align(whole.encode(), one.ids, other)
            for piece, whole, one, other in zip(pieces, after_space, a, b, strict=True)
        }

    def documents(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text its groups, its links' codes, and its numbers of tokens and groups."""
        known = self.known
        cut = [
            () if not text else _SAFE_CUT.split(text) if _RISKY.search(text) else text.split(" ")
            for text in texts
        ]
        for i, pieces in enumerate(cut):
            if pieces and _RISKY.search(texts[i]):
                cut[i] = [pieces[0], *(piece[1:] for piece in pieces[1:])]
        new = list({piece for pieces in cut for piece in pieces if piece not in known})
        here: dict = {}
        for start in range(0, len(new), 4096):
            here |= self._learn(new[start : start + 4096])
        room = REMEMBERED - len(known)
        known.update([(p, r) for p, r in here.items() if len(p) <= LONGEST][: max(0, room)])
        none = b"", np.zeros(0, np.int64), np.zeros(3, np.int64)
        for text, pieces in zip(texts, cut, strict=True):
            if not pieces:
                yield none
                continue
            found = [known[piece] if piece in known else here[piece] for piece in pieces]
            if None in found:  # some bytes differ; the whole text decides
                found = list(self._learn([text]).values())
                if None in found:
                    yield none
                    continue
            groups, links, numbers = zip(*found, strict=True)
            yield (
                b";".join(groups),
                np.frombuffer(b"".join(links), "<i8"),
                np.frombuffer(b"".join(numbers), "<i8").reshape(-1, 3).sum(axis=0),
            )


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    return lasting(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def unpacked(codes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links of a document, in order, and how often each occurs in it."""
    return np.cumsum(np.frombuffer(codes, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)


def align(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its number ``row``, its id, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, and ``groups``, as ``a1,a2|b1;a3|b2,b3``.

    ``codes`` and ``times`` hold the document's distinct links for :func:`unpacked`, a link of
    ``a`` and ``b`` having the code ``a`` times B's vocabulary plus ``b``. A text that is null,
    empty, or not given back by both tokenizers' bytes has no tokens, zeros and empty groups.
    Further columns are not passed on; repeated rows and null ids are rows like any other.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (size < SENT or end == start):
                    size += 8 * len(texts[end] or "")
                    end += 1
                yield some(own, batch.slice(start, end - start), texts[start:end])
                start = end

    def some(own: Aligner, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        numbers, n_links, groups, codes, times = [], [], [], [], []
        with no_collections():
            for text, links, three in own.documents(texts):
                distinct, often = np.unique(links, return_counts=True)
                numbers.append(three)
                n_links.append(len(links))
                groups.append(text)
                codes.append(np.diff(distinct, prepend=0).astype("<i8").tobytes())
                times.append(often.astype("<u4").tobytes())
        n_a, n_b, n_groups = np.array(numbers, np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(n_a), pa.array(n_b),
                pa.array(n_groups), pa.array(n_links, pa.int64()),
                pa.array(groups, pa.binary()).cast(pa.string()),
                pa.array(codes, pa.binary()), pa.array(times, pa.binary()),
            ],
            ["row", doc_id, "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times"],
        )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id, text)
    return rows.mapInArrow(run, _ALIGNED.format(id=f"`{doc_id}`", type=kind))


def count_links(links: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How many rows of ``links`` (``codes``, ``times``) hold each link: ``code``, ``docs``.

    A task counts links of twins in a vector and adds up all others before it passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        vector = np.zeros(len(own.twin_codes), np.int64)
        held, sums, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        n_waiting = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([held, *waiting])
            ones = np.ones(len(codes) - len(held), np.int64)
            distinct, where = np.unique(codes, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, where, np.concatenate([sums, ones]))
            return distinct, total

        def rows(codes: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(codes), 100_000):
                both = (pa.array(x[start : start + 100_000]) for x in (codes, docs))
                yield pa.RecordBatch.from_arrays(list(both), ["code", "docs"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                codes = np.cumsum(np.frombuffer(packed, "<i8"))
                ids = codes // own.n_b
                twins = own.twin_codes[ids] == codes
                vector[ids[twins]] += 1  # a document's links are distinct
                waiting.append(codes[~twins])
                n_waiting += len(waiting[-1])
                if n_waiting > HELD:
                    held, sums = added()
                    waiting, n_waiting = [], 0
                    if len(held) > HELD:
                        yield from rows(held, sums)
                        held, sums = held[:0], sums[:0]
        held, sums = added()
        yield from rows(held, sums)
        seen = np.flatnonzero(vector)
        yield from rows(own.twin_codes[seen], vector[seen])

    counted = links.select("codes").mapInArrow(run, "code long, docs long")
    return counted.groupBy("code").agg(F.sum("docs").alias("docs"))


def _shipped(
    counts: DataFrame, n_a: int, n_b: int
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The most frequent links' codes and counts and the highest count for each A id, for the
    workers, and the count from which a link is among them.

    Links in so many documents are at most ``SHIPPED``, for all counts would sum up to more
    otherwise; the best counts are as many as A has ids.
    """
    total = counts.agg(F.sum("docs")).first()[0] or 0
    least = total // SHIPPED + 1
    often = counts.filter(F.col("docs") >= least).toPandas().sort_values("code")
    tops = counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("docs").alias("docs"))
    top = tops.toPandas()
    best = np.zeros(n_a, np.int64)
    best[top["a"].to_numpy(np.int64)] = top["docs"].to_numpy(np.int64)
    return (often["code"].to_numpy(np.int64), often["docs"].to_numpy(np.int64), best), least


def score(links: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of ``links`` with ``n_best`` and ``count_sum`` in place of their links.

    ``n_best`` are a document's links that no other link of the same A id exceeds in ``counts``,
    ``count_sum`` the counts of all its links. Frequent links are looked up in the workers, the
    others, which no document shares with many, by a join.
    """
    own = Aligner(a_path, b_path)
    n_b = own.n_b
    shipped, least = _shipped(counts, len(own.a_bytes), n_b)
    sent = links.sparkSession.sparkContext.broadcast(shipped)
    kept = [name for name in links.columns if name not in ("codes", "times")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, frequent_docs, tops = sent.value
        for batch in batches:
            n_best, sums, rest, rest_times = [], [], [], []
            packed = zip(
                batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True
            )
            for codes, times in (unpacked(*both) for both in packed):
                at = np.searchsorted(frequent, codes)
                at[at == len(frequent)] = 0
                hit = frequent[at] == codes if len(frequent) else np.zeros(len(codes), bool)
                docs, often = frequent_docs[at[hit]], times[hit]
                n_best.append(int(often[docs == tops[codes[hit] // n_b]].sum()))
                sums.append(int((docs * often).sum()))
                rest.append(codes[~hit])
                rest_times.append(times[~hit])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in kept),
                    pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()),
                    pa.array(rest, pa.list_(pa.int64())),
                    pa.array(rest_times, pa.list_(pa.int64())),
                ],
                [*kept, "n_best", "count_sum", "rest", "rest_times"],
            )

    schema = ", ".join([*fields, "n_best long, count_sum long"])
    looked = stored(
        links.mapInArrow(run, f"{schema}, rest array<bigint>, rest_times array<bigint>"), "looked"
    )
    rare = looked.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("one")).select(
        "row", F.col("one.rest").alias("code"), F.col("one.rest_times").alias("times")
    )
    best = counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("docs").alias("best"))
    rare_counts = counts.filter(F.col("docs") < least).withColumn("a", F.expr(f"code div {n_b}"))
    judged = rare_counts.join(best, "a").select(
        "code", "docs", (F.col("docs") == F.col("best")).cast("long").alias("is_best")
    )
    more = rare.join(judged, "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("is_best")).alias("_best"),
        F.sum(F.col("times") * F.col("docs")).alias("_sum"),
    )
    return (
        looked.drop("rest", "rest_times")
        .join(more, "row", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
        .drop("_best", "_sum")
    )


def aligned_documents(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs`` the numbers of :func:`align` and :func:`score`, and the digest
    ``groups_sha256`` of its groups, empty for a document without tokens."""
    aligned = align(docs, a_path, b_path, doc_id, text)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    narrow = aligned.withColumn("groups_sha256", digest).drop("groups")
    links = stored(narrow, "aligned", compression="zstd")
    counts = stored(count_links(links, a_path, b_path), "pairs")
    return score(links, counts, a_path, b_path).drop("row")
