"""The registered queries over the smallest tables: columns, rows and what binds them."""

from __future__ import annotations

import pytest

from maillode.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_duplicates": "doc_id n_shingles component_id kept",
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op3_token_counts": "doc_id n_words n_tokens",
    "op4_mixing": "doc_id size source_size target taken",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_languages": "doc_id held_out lang_pred score",
    "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_licences": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_near_vectors": "vec_id n_links component_id kept",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}
ONE_ROW_EACH = sorted(set(COLUMNS) - {"op7_packing"})


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_row(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    source, key = ("embeddings", "vec_id") if "op9" in name else ("documents", "doc_id")
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    ids = sorted(row[key] for row in frame.select(key).collect())
    table = spark.read.parquet(f"{SF_DIR}/{source}.parquet")
    assert ids == sorted(row[key] for row in table.select(key).collect())


def test_held_out_accuracy(spark):
    told = QUERIES["op6_languages"](spark, SF_DIR).filter("held_out")
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    met = told.join(truth, "doc_id").filter("lang IS NOT NULL AND length(text) > 20")
    right = met.filter("lang = lang_pred").count()
    assert right >= 0.95 * met.count() > 0


def test_packing_covers_every_document(spark):
    packed = QUERIES["op7_packing"](spark, SF_DIR)
    tokens = QUERIES["op2_token_files"](spark, SF_DIR)
    sums = packed.groupBy("doc_id").agg({"length": "sum"})
    wrong = tokens.join(sums, "doc_id", "left").filter("n_tokens <> `sum(length)` OR `sum(length)` IS NULL")
    assert wrong.count() == 0
