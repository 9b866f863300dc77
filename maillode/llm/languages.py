"""Languages of a document as a mixture, inferred by expectation-maximisation.

A language is a distribution over byte trigrams, hashed to ``FEATURES`` classes and counted
over all labelled texts. A document is a mixture of languages: expectation-maximisation finds
the proportions under which its trigrams are likeliest. Languages enter the document's set one
by one, by their proportion, as long as the likelihood gains more than a penalty for each; the
prediction is the language with the largest proportion in that set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 4096
#: Added to every count.
SMOOTHING = 0.5
ROUNDS = 12
#: Neighbouring trigrams share bytes and so count for less than one observation each.
TRIGRAM_WEIGHT = 1 / 3
#: Of the Bayesian information criterion, for each language after the first.
PENALTY = 2.0
#: Documents that are evaluated together.
BLOCK = 64
#: Bytes whose trigrams are held at once; longer documents are counted piece by piece.
PIECE_BYTES = 1 << 20
NONE = "und"


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  # of each feature, by language


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed trigrams: a row a text. Digits, signs and white space are one class."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        for start in range(0, len(text), PIECE_BYTES):
            part = _CLASSES[np.frombuffer(text[start : start + PIECE_BYTES + 2], np.uint8)]
            if len(part) > 2:
                codes = (part[:-2] * 0x9E3779B1 + part[1:-1] * 0x85EBCA77 + part[2:] * 0xC2B2AE3D)
                codes ^= codes >> np.uint32(15)
                codes = (codes * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
                out[i] += np.bincount(codes, minlength=FEATURES)
    return out


def _byte_classes() -> np.ndarray:
    classes = np.full(256, 32, np.uint32)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalpha():
            classes[byte] = byte
    return classes


_CLASSES = _byte_classes()


def _prepared(texts: list[str | None]) -> list[bytes]:
    return [f" {text.lower()} ".encode() if text else b"" for text in texts]


def train(labelled: DataFrame) -> Model:
    """From rows of ``text`` and ``lang``. Counts are added up per task, then over tasks; the
    driver gets ``FEATURES`` numbers for each language, and no text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                counts = features(_prepared(part["text"].to_pylist()))
                for lang, row in zip(part["lang"].to_pylist(), counts, strict=True):
                    total = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
                    total += row.astype(np.int64)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [lang] * FEATURES,
                    "feature": np.arange(FEATURES, dtype=np.int32),
                    "n": total,
                }
            )

    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = usable.mapInArrow(count, "lang string, feature int, n long")
    rows = parts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({row["lang"] for row in rows})
    counts = np.full((len(languages), FEATURES), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    for row in rows:
        counts[place[row["lang"]], row["feature"]] += row["n"]
    return Model(languages, counts / counts.sum(axis=1, keepdims=True))


def _mixture(
    counts: np.ndarray, chances: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and the log-likelihood, for each row of counts."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(ROUNDS):
        share = share * ((counts / (share @ chances)) @ chances.T) / total
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return share, (counts * np.log(share @ chances)).sum(axis=1)


def infer(counts: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions under the chosen language set of each row (0: not chosen), and its size."""
    n, languages = len(counts), len(chances)
    chances = chances.astype(np.float32)
    single = counts @ np.log(chances).T
    best = single.argmax(axis=1)
    chosen = np.zeros((n, languages), np.float32)
    chosen[np.arange(n), best] = 1
    score = single.max(axis=1) * TRIGRAM_WEIGHT
    size = np.ones(n, np.int64)
    if languages == 1:
        return chosen, size
    share, _ = _mixture(counts, chances, np.ones_like(chosen))
    order = np.argsort(-share, axis=1)
    cost = PENALTY * 0.5 * np.log(np.maximum(counts.sum(axis=1) * TRIGRAM_WEIGHT, 2))
    growing = share.max(axis=1) < 0.999
    for k in range(2, languages + 1):
        rows = np.flatnonzero(growing)
        if not len(rows):
            break
        allowed = np.zeros((len(rows), languages), np.float32)
        np.put_along_axis(allowed, order[rows, :k], 1, axis=1)
        part, likelihood = _mixture(counts[rows], chances, allowed)
        gained = likelihood * TRIGRAM_WEIGHT - (k - 1) * cost[rows]
        better = gained > score[rows]
        chosen[rows[better]], score[rows[better]] = part[better], gained[better]
        size[rows[better]] = k
        growing[rows[~better]] = False
    return chosen, size


def lettered(text: str = "text"):
    """Whether a text has a letter; a null one hasn't."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion), ``n_langs`` (size of the language set).

    A text that is null or has no letter gets ``und`` and 0, and so does every text if nothing
    was learned. A letter-bearing text too short for a trigram gets the first language, by
    name. Only the text is looked at; columns named as the results are replaced.
    """
    docs = docs.drop("lang_pred", "score", "n_langs")
    if not model.languages:
        return docs.withColumns(
            {"lang_pred": F.lit(NONE), "score": F.lit(0.0), "n_langs": F.lit(0)}
        )
    # Plain values: a worker need not be able to import this package.
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.chances))

    @F.pandas_udf("lang string, score double, size int")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, chances = sent.value
        names = np.array(languages, dtype=object)
        for batch in batches:
            lang, score, size = [], [], []
            for start in range(0, len(batch), BLOCK):
                texts = _prepared(batch.iloc[start : start + BLOCK].tolist())
                share, sizes = infer(features(texts), chances)
                lang.append(names[share.argmax(axis=1)])
                score.append(share.max(axis=1))
                size.append(sizes)
            if lang:
                yield pd.DataFrame(
                    {
                        "lang": np.concatenate(lang),
                        "score": np.concatenate(score).astype(float).clip(0, 1),
                        "size": np.concatenate(size).astype(np.int32),
                    }
                )
            else:
                yield pd.DataFrame({"lang": [], "score": [], "size": []})

    known = lettered(text)
    seen = docs.withColumn("_seen", look(F.coalesce(F.col(text), F.lit(""))))
    return seen.withColumns(
        {
            "lang_pred": F.when(known, F.col("_seen.lang")).otherwise(NONE),
            "score": F.when(known, F.col("_seen.score")).otherwise(0.0),
            "n_langs": F.when(known, F.col("_seen.size")).otherwise(0),
        }
    ).drop("_seen")
