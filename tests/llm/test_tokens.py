"""Token files, packing and token counts against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from maillode.llm import packing, token_counts, token_files
from maillode.llm.queries import vocabulary
from maillode.llm.shared import shared_path
from maillode.llm.tokens import BulkEncoder

from . import cases

BPE = vocabulary("byte_bpe_50k.json")
PIECES = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bulk_encoder(plain, monkeypatch):
    monkeypatch.setattr("maillode.llm.tokens.REMEMBERED", 50)
    random.seed(3)
    parts = [" ", "  ", "\n", "a", "Word", "ß", "日本", ".", ",", "'s", "12", "\t", "\xa0",
             " ", "\x1c", "<|endoftext|>", "😀", "\r\n", "\x00", "é", "ly."]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)]
    texts += [row[1] for row in cases.rows()]
    encoder = BulkEncoder(BPE)
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        for text, ids in zip(some, encoder.batch(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def test_token_files_round_trip(spark, docs, plain):
    path = shared_path(spark, "test-tokens")
    token_files.write_token_files(docs.withColumn("start", F.lit("clash")), path, BPE)
    read = token_files.read_token_files(spark, path).collect()
    whole = token_files.read_token_files(spark, path, ids=True).collect()
    rows = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0]))
    assert sorted(r["start"] for r in read) == [r["start"] for r in sorted(read, key=lambda r: r["start"])]
    texts = {row[0]: row[1] for row in rows}
    start = 0
    for row, ids in zip(sorted(read, key=lambda r: r["start"]), sorted(whole, key=lambda r: r["start"]), strict=True):
        expected = [*plain(texts[row["doc_id"]]), 0]
        assert row["start"] == ids["start"] == start and ids["ids"] == expected
        assert row["n_tokens"] == len(expected)
        assert row["ids_crc32"] == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += len(expected)
    order = [r["doc_id"] for r in sorted(read, key=lambda r: r["start"])]
    assert order == [r[0] for r in rows]
    with pytest.raises(AnalysisException, match="isn't empty"):
        token_files.write_token_files(docs.limit(2), path, BPE)
    assert token_files.read_token_files(spark, path).count() == len(rows)


def test_token_files_of_nothing(spark, none):
    path = shared_path(spark, "test-tokens")
    token_files.write_token_files(none, path, BPE)
    assert token_files.read_token_files(spark, path).collect() == []


def test_packing(docs, plain):
    pieces = packing.cut_pieces(docs.withColumn("offset", F.lit("clash")), BPE, with_ids=True)
    got = packing.pack(pieces).toPandas()
    total: dict = {}
    for row in cases.rows():
        total[row[0]] = total.get(row[0], 0) + len(plain(row[1])) + 1
    assert got["length"].sum() == sum(total.values())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (np.r_[0, np.cumsum(own["length"])[:-1]] == own["offset"]).all()
        assert own["length"].sum() <= packing.CAPACITY
    for row in got.itertuples():
        assert len(row.ids) == 4 * row.length and zlib.crc32(row.ids) == row.ids_crc32
        assert row.piece == 0 or row.length == packing.CAPACITY
    need = -(-got["length"].sum() // packing.CAPACITY)
    assert got["sequence_id"].nunique() <= need + 1
    whole = packing.sequences(packing.pack(pieces)).toPandas()
    assert sum(map(len, whole["ids"])) == 4 * got["length"].sum()


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, BPE).collect() == []


@pytest.mark.parametrize("shape", ["mixed", "large", "hot"])
def test_runs_against_best_fit_decreasing(shape):
    draw = np.random.default_rng(7)
    lengths = {
        "mixed": np.clip(draw.lognormal(6, 1.2, 4000), 1, 2048).astype(int),
        "large": draw.integers(600, 800, 4000),
        "hot": np.r_[np.full(3000, 433), draw.integers(1, 2049, 4000)],
    }[shape]
    classes = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)), strict=True))
    runs = packing.best_fit_runs(classes, 2048)
    used = (runs[:, 3] + runs[:, 2]).max()
    fill = np.zeros(used, int)
    for length, _, n, first, offset in sorted(runs.tolist(), key=lambda r: r[4]):
        assert (fill[first : first + n] == offset).all()
        fill[first : first + n] += length
    assert fill.max() <= 2048
    for length, n in classes.items():  # every rank has one place
        own = runs[runs[:, 0] == length]
        assert (np.r_[0, np.cumsum(own[:, 2])] == np.r_[own[:, 1], n]).all()
    gaps, bins = np.zeros(2049, int), 0
    for length in sorted(classes, reverse=True):
        for _ in range(classes[length]):
            at = np.flatnonzero(gaps[length:])
            gap = at[0] + length if len(at) else 2048
            bins += not len(at)
            gaps[gap] -= len(at) > 0
            gaps[gap - length] += 1
    assert used <= 1.005 * bins + 1


def test_token_counts(docs):
    pieces = token_counts.read_pieces(PIECES)
    lowest = min(pieces.values()) - 1000
    model = Tokenizer(models.Unigram([("<unk>", lowest), *pieces.items()], 0, False))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    for row in cases.rows():
        seen = (row[1] or "").split()
        assert got[row[0]]["n_words"] == len(seen)
        encoded = [model.encode("▁" + word).ids for word in seen]
        if not any(0 in ids for ids in encoded):
            assert got[row[0]]["n_tokens"] == sum(map(len, encoded))


def test_trie_shares_and_restarts(monkeypatch):
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -1.5}
    trie = token_counts.Trie(pieces)
    assert trie.count("ab") == 2 and trie.nodes == 4
    assert trie.count("abb") == 3 and trie.nodes == 5
    assert trie.count("é") == 3  # the mark and two bytes
    monkeypatch.setattr(token_counts, "MOST_NODES", 3)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 1)
    assert trie.count("ab") == 2 and trie.nodes == 4
    assert trie.count_all(["ab", "abb", "ab"]) == 7 and not trie.counts


def test_token_counts_of_nothing(none):
    assert token_counts.count_tokens(none, PIECES).collect() == []


def test_pieces_that_are_not_remembered_are_encoded_each_time():
    few = BulkEncoder(BPE, remembered=3)
    texts = ["one two, three four five", "six two. seven\neight one", None, "", "one two, nine ten"] * 3
    want = [few.whole(text) if text else b"" for text in texts]
    assert [few.batch([text])[0] for text in texts] == want == few.batch(texts)
    assert len(few.known) <= 3 + 4
