"""The pipeline's stages in turn, and on odd tables."""

from __future__ import annotations

import zlib

import corpus_pipeline

from . import cases


def test_stages_keep_the_columns(spark, docs, none):
    frame, empty = docs, none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, empty = stage(spark, frame, ""), stage(spark, empty, "")
        assert frame.columns == docs.columns, name
        assert empty.count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "")
    assert packed.count() >= frame.count()


def test_dedup_stages(spark, docs):
    texts = {row[0]: row[1] for row in cases.rows() if row[0] is not None}
    kept = corpus_pipeline.one_of_equal_texts(spark, docs, "")
    left = {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"] is not None}
    assert sorted(left) == sorted({(t or ""): i for i, t in sorted(texts.items())}.values())
    near = corpus_pipeline.one_of_near_duplicates(spark, kept, "")
    expected = cases.smallest_reachable(left, cases.jaccard_links(left))
    assert {r["doc_id"] for r in near.collect()} - {None} == {i for i, c in expected.items() if i == c}


def test_exact_dedup_keeps_one_row_of_equal_texts(spark):
    rows = [*cases.rows(), (None, "text without an id", "de", "s1", 3), (None, None, "en", "s0", 0)]
    rows += [(None, "all without", "en", "s0", 0)] * 3 + [(70, "twice", lang, "s0", 0) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, cases.DOCS).repartition(3)
    got = corpus_pipeline.one_of_equal_texts(spark, docs, "").collect()
    assert sorted(r["text"] or "" for r in got) == sorted({r[1] or "" for r in rows})
    assert {tuple(r) for r in got} <= set(rows)
    largest = {}
    for i, text, *_ in rows:
        largest[text or ""] = max(largest.get(text or "", -1), -1 if i is None else i)
    assert {r["text"] or "": -1 if r["doc_id"] is None else r["doc_id"] for r in got} == largest


def test_texts_stay_when_no_language_was_learned(spark):
    rows = cases.rows()
    lettered = sorted(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    unlabelled = [(i, text, None, *more) for i, text, _, *more in rows]
    for table in (unlabelled, [(held, text, "en", *more) for _, text, _, *more in rows], rows):
        docs = spark.createDataFrame(table, cases.DOCS)
        got = corpus_pipeline.known_language(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(r["text"] for r in got.collect()) == lettered


def test_a_label_called_und_is_a_language(spark):
    rows = [(i, f"some words of number {i}", "und" if i % 2 else "en", "s", 0) for i in range(80)]
    docs = spark.createDataFrame([*rows, (80, "123 !!", "und", "s", 0)], cases.DOCS)
    assert corpus_pipeline.known_language(spark, docs, "").count() == 80


def test_runs_over_a_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 100 and rows.filter("offset + length > 2048").count() == 0
