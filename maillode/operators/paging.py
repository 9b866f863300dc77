"""Pages far down a listing, without sorting it anew for each.

Two ways lead to them. The page after a known row is found by that row's sort key
(:func:`rows_after`), which is a filter and a top-k. A page with a given number is found in a kept
order: the keys of a listing, sorted once and written, with the number of rows that stand before
each file. Only the files that hold rows of the page are read then.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_fold

FILE = "_metadata.file_path"


@dataclass(frozen=True)
class SortKey:
    """One column of a sort: NULL comes first where it rises, last where it falls."""

    column: str
    up: bool
    folded: bool = False

    def of(self, value: Column) -> Column:
        return ascii_fold(value) if self.folded else value

    def order(self) -> Column:
        key = self.of(F.col(self.column))
        return key.asc_nulls_first() if self.up else key.desc_nulls_last()

    def beyond(self, last: object) -> Column:
        """Whether a row's value comes after the value ``last``."""
        key = self.of(F.col(self.column))
        if last is None:
            return key.isNotNull() if self.up else F.lit(False)
        value = self.of(F.lit(last))
        return key > value if self.up else (key < value) | key.isNull()

    def level(self, last: object) -> Column:
        key = self.of(F.col(self.column))
        return key.isNull() if last is None else key == self.of(F.lit(last))


def rows_after(keys: Sequence[SortKey], last: Mapping) -> Column:
    """Condition of the rows that come after the row ``last`` in the order of ``keys``.

    It consists of plain comparisons, so a scan can test it on the statistics of its row groups.
    """
    first, *others = keys
    value = last[first.column]
    if not others:
        return first.beyond(value)
    return first.beyond(value) | (first.level(value) & rows_after(others, last))


def page_after(rows: DataFrame, keys: Sequence[SortKey], last: Mapping, size: int) -> DataFrame:
    """The ``size`` rows after ``last``, a row of the page before with its ``pos``."""
    order = [key.order() for key in keys]
    top = rows.filter(rows_after(keys, last)).orderBy(*order).limit(size)
    # The window sees one page at most.
    nth = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.withColumn("pos", nth + last["pos"])


def write_order(rows: DataFrame, order: Sequence[Column], path: str) -> None:
    """Keep ``rows`` in ``order`` at ``path``, a new folder, for :func:`page_in_order`.

    The rows are dealt into ranges and sorted by task. ``files`` holds a row for each file, so the
    window over it is small; it is written last, and an order without it can't be read.
    """
    spark = rows.sparkSession
    ordered = rows.orderBy(*order).withColumn("__serial", F.monotonically_increasing_id())
    ordered.write.parquet(f"{path}/rows")
    stored = spark.read.schema(ordered.schema).parquet(f"{path}/rows")
    # Serials rise through the files, and without gaps within one of them.
    files = stored.groupBy(F.col(FILE).alias("file")).agg(
        F.min("__serial").alias("first"), F.count("*").alias("n")
    )
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))
    files.withColumn("before", before).write.parquet(f"{path}/files")


def page_in_order(spark: SparkSession, path: str, skip: int, size: int) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + size`` of a kept order, with ``pos`` counting from 1.

    Reads the files with such rows, of which there are ``size`` at most, in as many tasks as
    they need.
    """
    files = spark.read.parquet(f"{path}/files")
    inside = (F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip)
    found = files.filter(inside).collect()
    stored = spark.read.parquet(f"{path}/rows")
    rows = stored.withColumn("__file", F.col(FILE)).filter(
        F.col(FILE).isin([row["file"] for row in found])
    )
    bounds = spark.createDataFrame(found, files.schema).select(
        F.col("file").alias("__file"), F.col("first").alias("__first"), F.col("before").alias("__before")
    )
    pos = F.col("__before") + F.col("__serial") - F.col("__first") + 1
    numbered = rows.join(F.broadcast(bounds), "__file").withColumn("pos", pos)
    page = numbered.filter((F.col("pos") > skip) & (F.col("pos") <= skip + size))
    return page.drop("__file", "__first", "__before", "__serial")
