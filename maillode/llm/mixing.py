"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size says how often each of its documents should be taken:
a whole number of copies and a fraction. Fractions move mass, at random and without bias, until
they are 0 or 1. Blocks of documents do this on their own, longest documents first: a document
is paired with all shorter ones of its block together, whose fractions take up its words evenly,
so that the words of the block stay as they are. Documents that the shorter ones can't make up
for stay in play; a reduction tree joins these remainders, ``FAN_IN`` blocks at a time, and the
last ones of a source are paired one by one. Every step keeps each document's chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stored

BLOCK_ROWS = 4096
FAN_IN = 64
#: So many documents of a block, and one more, may stay in play for the next level.
LONGEST = 16
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_TINY = 1e-12


def size_in_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``source``, ``source_size``, ``source_rows``, ``target``: a row for each source.

    Filling up: sources in the order in which they reach their limit are full as long as the
    level that the rest would get lies above their own. One row a source meets in one task.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1
    )
    weighed = sources.withColumn("_weight", weight.cast("double")).withColumn(
        "_limit", F.col("source_size") * most
    )
    by_limit = Window.orderBy(
        F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last()
    )
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(Window.partitionBy()) * share
        - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(rest)
    filled = weighed.withColumn("_level", level).withColumn(
        "_open", F.col("_level") * F.col("_weight") < F.col("_limit")
    )
    # The first source that its level doesn't fill sets the level of all after it.
    final = F.min(F.when(F.col("_open"), F.struct(F.col("_limit") / F.col("_weight"), "_level")))
    filled = filled.withColumn("_final", final.over(everything)["_level"])
    reached = F.least("_limit", F.col("_final") * F.col("_weight"))
    return filled.select(
        "source", "source_size", "source_rows", F.coalesce(reached, "_limit").alias("target")
    )


def round_pairs(fractions: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The fractions after pivotal rounding in this order: 0 or 1, but for one at most."""
    out = fractions.astype(float).copy()
    chances = draw.random(len(out))
    held = -1  # the one still in play
    for i, b in enumerate(out.tolist()):
        if not _TINY < b < 1 - _TINY:
            out[i] = round(b)
            continue
        if held < 0:
            held, a = i, b
            continue
        both = a + b
        if both < 1 - _TINY:
            if chances[i] * both < a:  # the held one gets all
                out[i], a = 0.0, both
            else:
                out[held], held, a = 0.0, i, both
        elif both > 1 + _TINY:
            if chances[i] * (2 - both) < 1 - b:
                out[held], held, a = 1.0, i, both - 1
            else:
                out[i], a = 1.0, both - 1
        else:
            first = chances[i] < a
            out[held], out[i], held = float(first), float(not first), -1
    if held >= 0:
        out[held] = a
    return out


def round_words(
    fractions: np.ndarray, words: np.ndarray, draw: np.random.Generator, longest: int
) -> np.ndarray:
    """The fractions after one draw in this order, longest first: 0 or 1, but for ``longest`` + 1
    at most.

    What a document gains or loses in words, all after it lose or gain, by equal fractions. One
    for which these would leave 0 to 1 is passed over; of those passed over, ``longest`` stay as
    they are and the others are paired.
    """
    out = fractions.astype(float).copy()
    after = words[::-1].cumsum()[::-1] - words
    least = np.r_[np.minimum.accumulate(out[::-1])[::-1][1:], 0.0]
    most = np.r_[np.maximum.accumulate(out[::-1])[::-1][1:], 1.0]
    chances = draw.random(len(out))
    shift, passed = 0.0, []
    for i in range(len(out)):
        a = out[i] + shift
        if not _TINY < a < 1 - _TINY:
            out[i] = round(a)
            continue
        part = words[i] / after[i] if after[i] else np.inf
        low, high = least[i] + shift - (1 - a) * part, most[i] + shift + a * part
        if low > _TINY and high < 1 - _TINY:
            out[i] = float(chances[i] < a)
            shift += (a - out[i]) * part
        else:
            out[i] = a
            passed.append(i)
    paired = passed[longest:]
    out[paired] = round_pairs(out[paired], draw)
    return out


def mix(sized: DataFrame, seed: int = 1, keep: Sequence[str] = (), **law) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` and ``taken`` to rows with ``doc_id``,
    ``source`` and ``size``; no other columns are kept but those named in ``keep``.

    A null source is a source. Rows may repeat: each counts. A source without words has a
    target of 0 and takes nothing. ``copies`` is 0, 1 or 2. The draw depends on the rows and
    ``seed`` alone, neither on partitions nor on retries.
    """
    sized = stored(sized.select("doc_id", "source", "size", *keep), "sized")
    targets = stored(source_targets(sized, **law), "targets")
    most_rows = targets.agg(F.max("source_rows")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("source_rows") / BLOCK_ROWS)
    # A left side of any size meets a row for each source; AQE splits a large source.
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_source")
    keyed = targets.select(
        source_key, "source_size", "target", rate.alias("_rate"), blocks.alias("_blocks")
    )
    rows = (
        sized.withColumn("_source", source_key)
        .join(keyed, "_source")
        .withColumn("_whole", F.floor("_rate").cast("long"))
        .withColumn("mass", F.col("_rate") - F.col("_whole"))
        .withColumn(
            "node", F.pmod(F.xxhash64("doc_id", "size"), F.col("_blocks")).cast("long")
        )
        .drop("_rate", "_blocks")
    )
    schema = rows.schema

    def reducer(depth: int, last: bool):
        def reduce(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(
                ["size", "doc_id", "mass", *keep],
                ascending=[False, True, True, *[True] * len(keep)], kind="stable", ignore_index=True,
            )
            draw = np.random.default_rng([seed, zlib.crc32(key[0].encode()), int(key[1]), depth])
            fractions, words = part["mass"].to_numpy(), part["size"].to_numpy()
            mass = round_words(fractions, words, draw, 0 if last else LONGEST)
            if last:  # one remainder a source: taken with the chance that is left to it
                mass = np.where((mass > 0) & (mass < 1), draw.random() < mass, mass)
            return part.assign(mass=mass.astype(float))

        return reduce

    settled, level, nodes, depth = [], rows, -(-most_rows // BLOCK_ROWS), 0
    while True:
        reduce = reducer(depth, nodes <= 1)
        done = stored(level.groupBy("_source", "node").applyInPandas(reduce, schema), "level")
        if nodes <= 1:
            settled.append(done)
            break
        open_ones = (F.col("mass") > 0) & (F.col("mass") < 1)
        settled.append(done.filter(~open_ones))
        level = done.filter(open_ones).withColumn("node", F.expr(f"node div {FAN_IN}"))
        nodes, depth = -(-nodes // FAN_IN), depth + 1
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    copies = (F.col("_whole") + F.col("mass")).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep,
    )


PLACE = ["_file", "_place"]


def _with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_place``, which tell its rows apart on every read.

    Of a table these are a row's file and its number in there. Rows that don't come straight from
    files, or several of them from one place, are written to some first.
    """

    def placed(rows: DataFrame) -> DataFrame:
        file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        return rows.select("*", file.alias("_file"), place.alias("_place"))

    docs = docs.drop(*PLACE)
    try:
        found = placed(docs)
        if found.groupBy(*PLACE).count().filter("count > 1").isEmpty():
            return found
    except AnalysisException:
        pass  # these rows have no files
    return placed(stored(docs, "placed"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are told apart by where they stand, so ids may be null or repeat. The texts are shuffled
    once, to meet their rows' number of copies.
    """
    placed = _with_places(docs)
    sized = placed.select("doc_id", "source", size_in_words().alias("size"), *PLACE)
    taken = mix(sized, seed, keep=PLACE).filter("copies > 0").select(*PLACE, "copies")
    # File names shrink so well in a shuffle that Spark would take this side for a small one and
    # broadcast sixty times what it has seen.
    taken = taken.withColumnRenamed("copies", "_copies").hint("merge")
    met = placed.join(taken, PLACE)
    again = met.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return again.select(*docs.columns)
