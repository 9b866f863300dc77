"""From raw documents to packed training sequences, in five stages.

Each stage takes the rows that the one before it kept, with the columns of ``documents``, and
is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from maillode.llm import exact, languages, mixing, near, packing  # noqa: E402
from maillode.llm.queries import held_out, vocabulary  # noqa: E402
from maillode.llm.shared import stored, table  # noqa: E402


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, with no regard to which language it is taken for.

    That is what ``languages.predict`` calls known, if a language was learned. If none was, as
    in a table without labels, nothing is known to it, and the letters are looked at here.
    """
    model = languages.train(docs.filter(~held_out()))
    if not model.languages:
        return docs.filter(languages.lettered())
    # A learned label may be called as the mark of no language is; the size of the set tells.
    told = languages.predict(docs, model).filter("n_langs > 0")
    return told.select(*docs.columns)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: a row of the document with the largest id."""
    return exact.without_copies(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that hang together by similarity, the document with the smallest id."""
    return near.without_near_duplicates(docs)


def mixed_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document stands in no, one or two rows."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each with its sequence and place. Repeated rows are packed each."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equal_texts),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("mixing sources to target weights", mixed_by_weight),
    ("best-fit packing", packed_sequences),
]

#: Language models, MinHash, random rounding and tokenizers are beyond SQL; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
