"""Search by a trigram index: one bitmap for each file of the occurrence table.

A row can only match a pattern if it has the pattern's trigrams, so a file without one of them
holds no match and is not read. What is read is still tested with the pattern itself.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from .browse import SEARCHED, BrowseParams, browse

#: Slots of a file's bitmap, fixed by Spark's bitmap functions: 4 KiB a file.
SLOTS = 32_768
#: Files that are named in a scan at most; where more may hold a match, all are read.
MOST_FILES = 10_000
FILE = "_metadata.file_path"


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS).cast("long"))


def trigram_bitmaps(rows: DataFrame) -> DataFrame:
    """(file, bitmap) of the folded trigrams in the columns that are searched.

    ``rows`` have these columns and their ``file``. The slots of a file are made distinct by hash
    in the tasks that read it, so that at most ``SLOTS`` rows a file leave them: Spark sorts what
    it makes a bitmap of, and would otherwise sort every trigram of every row.
    """

    def grams(column: str) -> Column:
        folded = ascii_fold(F.coalesce(F.col(column), F.lit("")))
        # In one pass, while a substring at each place would count letters from the start.
        return F.regexp_extract_all(folded, F.lit("(?s)(?=(...))"), 1)

    distinct = F.array_distinct(F.concat(*[grams(c) for c in SEARCHED]))
    found = rows.select("file", F.explode(distinct).alias("gram"))
    slots = found.select("file", _slot(F.col("gram")).alias("slot")).distinct()
    return slots.groupBy("file").agg(F.bitmap_construct_agg("slot").alias("bitmap"))


def update_bitmaps(occurrences: DataFrame, path: str) -> None:
    """Add the bitmaps of files that ``path`` has none of; files never change once written."""
    trigram_bitmaps(new_rows(occurrences, path)).write.mode("append").parquet(path)


def new_rows(occurrences: DataFrame, path: str) -> DataFrame:
    """(file, searched columns) of the rows in files that ``path`` has no bitmaps of.

    The names of known files go to the tasks that read, so that no text is shuffled by its file.
    """
    spark = occurrences.sparkSession
    try:
        known = spark.read.parquet(path).select("file")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], "file string")
    rows = occurrences.select(F.col(FILE).alias("file"), *SEARCHED)
    return rows.join(F.broadcast(known), "file", "left_anti")


def trigrams_of(q: str) -> list[str]:
    """The trigrams that every match of ``%q%`` has; % and _ stand for any letters."""
    runs = re.split("[%_]", q)
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


def files_with(bitmaps: DataFrame, q: str) -> DataFrame:
    """The files of (file, bitmap) that may hold a match of ``q``."""
    for gram in trigrams_of(q):
        slot = _slot(ascii_fold(F.lit(gram)))
        place, bit = (slot / 8).cast("int") + 1, (slot % 8).cast("int")
        byte = F.conv(F.hex(F.substring("bitmap", place, F.lit(1))), 16, 10).cast("int")
        bitmaps = bitmaps.filter(F.getbit(byte, bit) == 1)
    return bitmaps.select("file")


def search(
    occurrences: DataFrame, attachments: DataFrame, bitmaps: DataFrame, params: BrowseParams
) -> DataFrame:
    """The rows that :func:`browse` gives, from the files that may hold one.

    ``bitmaps`` are those of all files of ``occurrences`` (:func:`update_bitmaps`). All files are
    read where ``q`` has no three letters in a row, or where more than ``MOST_FILES`` may match.
    """
    if params.q and trigrams_of(params.q):
        found = files_with(bitmaps, params.q).limit(MOST_FILES + 1).collect()
        if len(found) <= MOST_FILES:
            occurrences = occurrences.filter(F.col(FILE).isin([row["file"] for row in found]))
    return browse(occurrences, attachments, params)
