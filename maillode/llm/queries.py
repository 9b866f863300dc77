"""The registered queries of this subpackage and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    exact,
    histogram,
    languages,
    licences,
    markup,
    mixing,
    near,
    packing,
    periodic,
    token_counts,
    token_files,
    vectors,
)
from .shared import shared_path, table

HELD_OUT_OF = 5
SHARDS = 24


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json")
    )
    return token_files.read_token_files(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.size_in_words().alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact.mark_copies(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_OF == 0


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = languages.train(docs.filter(~F.col("held_out")))
    predicted = languages.predict(docs.select("doc_id", "held_out", "text"), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    sharded = histogram.shard(keyed, "text_hash", "doc_id", "size", SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(
        table(spark, sf_dir, "documents"),
        vocabulary("byte_bpe_50k.json"),
        vocabulary("piece_bpe_32k.model"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.describe_runs(periodic.find_runs(docs, edited=True)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        "collapsed_sha256",
    )


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = markup.main_text(table(spark, sf_dir, "pages"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_languages": op6_languages,
    "op7_packing": op7_packing,
    "op8_licences": op8_licences,
    "op9_near_vectors": op9_near_vectors,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_main_text": op13_main_text,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept,
               sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size
              FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.body
    """,
}
