"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Every vector has the cell of its nearest centre, and visits other cells where it could have a
partner. If two vectors of cells g and h are at most d apart, then for one of the two, x say of
g, x.g - x.h is at most d * |g - h| / 2, as the two lie on either side of the plane between g
and h. So a vector visits the cells for which that holds, and every pair of linked vectors
meets in the home cell of one of them: cells lose nothing. What they save depends on how
clustered the vectors are. Cells are compared in blocks of a bounded number of rows, by labels,
and a block gives counts and a star for each group of linked vectors, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

LEAST_COSINE = 0.93
#: Distinct vectors on which centres are fitted, at most: those with the lowest hashes.
SAMPLE = 20_000
#: Vectors for which there is a cell, and the most cells there are.
CELL_VECTORS, MOST_CELLS = 4096, 1024
ROUNDS = 10
BLOCK = 1024


def spherical_means(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres of unit length; ``sample`` has unit vectors as rows."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.to_list(), dtype=np.float64)
    # Scaled first, so that squares neither vanish nor overflow.
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _routes(distinct: DataFrame, centres: np.ndarray, distance: float) -> DataFrame:
    """Add ``cells``: the home cell first, then those that the vector visits."""
    sent = distinct.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def route(vectors: pd.Series) -> pd.Series:
        centres, out = sent.value, []
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
        for start in range(0, len(vectors), 4096):
            near = unit_rows(vectors.iloc[start : start + 4096]) @ centres.T
            home = near.argmax(axis=1)
            short = near.max(axis=1, keepdims=True) - near <= distance * apart[home] / 2 + 1e-9
            for own, visits in zip(home.tolist(), short, strict=True):
                visits[own] = False
                out.append([own, *np.flatnonzero(visits).tolist()])
        return pd.Series(out)

    # Centres have one length; vectors of any other are compared in a cell of their own.
    width = centres.shape[1] if len(centres) else 0
    fits = F.size("embedding") == width
    usual = distinct.filter(fits).withColumn("cells", route("embedding"))
    return usual.unionByName(
        distinct.filter(~fits).withColumn("cells", F.array(F.lit(0)))
    )


def _block_links(part: pd.DataFrame, least: float) -> pd.DataFrame:
    """For each vector of a block pair: copies of the vectors it is linked with, and the
    smallest id of the vectors it hangs together with here."""
    ids, copies = part["head"].to_numpy(), part["copies"].to_numpy()
    rows, home = unit_rows(part["embedding"]), part["home"].to_numpy()
    side = part["side"].to_numpy()
    x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both, a block with itself
    linked = rows[x] @ rows[y].T >= least
    cell = int(part["cell"].iloc[0])
    for i, visits in enumerate(part["cells"].iloc[x]):
        # A pair that also meets in the other's home cell counts in the cell of lower number.
        lower = [c for c in visits[1:] if c < cell]
        if lower:
            linked[i, np.isin(home[y], lower)] = False
    same = ids[x][:, None] == ids[y][None]
    linked &= ~same
    n = np.zeros(len(part), np.int64)
    n[x] += linked @ copies[y]
    if not (side == 2).all():
        n[y] += copies[x] @ linked
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.where(linked, label[y][None], np.iinfo(np.int64).max)
        label[x] = np.minimum(label[x], low.min(axis=1, initial=np.iinfo(np.int64).max))
        low = np.where(linked, label[x][:, None], np.iinfo(np.int64).max)
        label[y] = np.minimum(label[y], low.min(axis=0, initial=np.iinfo(np.int64).max))
        if (label == before).all():
            break
    some = n > 0
    return pd.DataFrame({"head": ids[some], "links": n[some], "least": label[some]})


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Only vectors of the same length and label are compared. Vectors that are null, empty, zero
    or hold null or non-finite components, or have no label or id, are linked with nothing
    and kept. Rows that repeat an id are vectors of their own and link with each other.
    Other columns are ignored.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = finite & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long"), "label", e.alias("embedding"))
    usable = rows.filter(whole & F.col("vec_id").isNotNull())
    same = ["label", "embedding"]
    distinct = usable.groupBy(*same).agg(
        F.min("vec_id").alias("head"), F.count("*").alias("copies")
    )
    distinct = stored(distinct, "distinct")
    total = distinct.count()
    cells = min(MOST_CELLS, max(1, -(-total // CELL_VECTORS)))
    first = distinct.orderBy(F.xxhash64("head"), "head").limit(SAMPLE if cells > 1 else 1)
    sample = first.select("embedding").toPandas()["embedding"]
    width = len(sample.iloc[0]) if len(sample) else 0
    sample = sample[sample.map(len) == width]
    centres = spherical_means(unit_rows(sample), cells) if len(sample) else np.zeros((0, 0))
    distance = float(np.sqrt(max(0.0, 2 - 2 * least)))

    routed = stored(
        _routes(distinct, centres, distance)
        .withColumn("width", F.size("embedding"))
        .withColumn("home", F.col("cells")[0]),
        "routed",
    )
    met = routed.select("*", F.explode("cells").alias("cell"))
    key = ["label", "width", "cell"]
    met = met.withColumn("at_home", F.col("home") == F.col("cell"))
    counts = met.groupBy(*key).agg(
        F.ceil(F.sum(F.col("at_home").cast("long")) / BLOCK).cast("int").alias("_homes"),
        F.ceil(F.sum((~F.col("at_home")).cast("long")) / BLOCK).cast("int").alias("_visits"),
    )
    # Home blocks meet each other (i <= j) and every block of visitors.
    spread = F.xxhash64("head")
    own = F.when(F.col("at_home"), F.pmod(spread, F.col("_homes"))).otherwise(
        F.col("_homes") + F.pmod(spread, F.greatest("_visits", F.lit(1)))
    )
    partners = F.when(
        F.col("at_home"), F.sequence(F.lit(0), F.col("_homes") + F.col("_visits") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("_homes") - 1))
    dealt = (
        met.join(counts.filter("_homes > 0"), key)
        .withColumn("_own", own.cast("int"))
        .withColumn("_other", F.explode(partners))
        .select(
            *key, "head", "copies", "embedding", "home", "cells",
            F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
            F.when(F.col("_own") == F.col("_other"), 2)
            .when(F.col("_own") < F.col("_other"), 0).otherwise(1).alias("side"),
        )
    )
    found = dealt.groupBy(*key, "i", "j").applyInPandas(
        lambda part: _block_links(part, least), "head long, links long, least long"
    )
    found = stored(found, "found")
    counted = found.groupBy("head").agg(F.sum("links").alias("links"))
    grouped = components(found.select("head", "least"), "head", "least")
    facts = (
        distinct.select(*same, "head", "copies")
        .join(counted, "head", "left")
        .join(grouped.withColumnRenamed("node", "head"), "head", "left")
        .select(
            *same,
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "head").alias("component_id"),
        )
    )
    marked = usable.join(facts, same, "left").select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(whole & F.col("vec_id").isNotNull(), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return marked.unionByName(rest).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
