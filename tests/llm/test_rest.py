"""Mixing, languages, licences, vectors and shards."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maillode.llm import histogram, languages, licences, mixing, vectors

from . import cases


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_mix(docs, spark):
    sized = docs.select("doc_id", "source", mixing.size_in_words().alias("size"), F.lit(1).alias("mass"))
    got = mixing.mix(sized).toPandas()
    again = mixing.mix(sized.repartition(7)).toPandas()
    key = ["doc_id", "size"]
    assert got.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    assert len(got) == len(cases.rows())
    sizes: dict = {}
    for row in cases.rows():
        sizes[row[3]] = sizes.get(row[3], 0) + len(cases.words(row[1]))
    target = filled(sizes)
    for source, own in got.groupby("source", dropna=False):
        name = None if pd.isna(source) else source
        assert (own["source_size"] == sizes[name]).all()
        assert np.allclose(own["target"], target[name])
    assert got["copies"].isin([0, 1, 2]).all() and (got["taken"] == got["copies"] * got["size"]).all()


def test_mix_is_near_its_targets(spark):
    draw = np.random.default_rng(3)
    words = np.clip(draw.lognormal(5, 1, 20_000), 1, 20_000).astype(int).tolist()
    source = ["big" if i % 3 else f"s{i % 11}" for i in range(len(words))]
    rows = list(zip(range(len(words)), source, words, strict=True))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums["taken"] / sums["target"] - 1) < 0.01).all()


def test_rounding_keeps_the_sum_and_the_chances():
    draw = np.random.default_rng(1)
    fractions = np.array([0.2, 0.7, 0.5, 0.5, 0.9, 0.3, 0.4])
    drawn = np.array([mixing.round_pairs(fractions, draw) for _ in range(4000)])
    assert np.allclose(drawn.sum(axis=1), fractions.sum())
    assert (((drawn > 1e-9) & (drawn < 1 - 1e-9)).sum(axis=1) <= 1).all()
    assert np.allclose(drawn.mean(axis=0), fractions, atol=0.03)


def test_mix_keeps_the_chance_of_a_very_long_document(spark, monkeypatch):
    """In each source one document is as long as a third of the others together."""
    rows = []
    for s in range(300):
        words = [20_000, *[300] * 200, s + 1]
        rows += [(s * 1000 + i, f"s{s}", n) for i, n in enumerate(words)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for block in (mixing.BLOCK_ROWS, 150):  # with 150, half of the others are with it
        monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
        got = mixing.mix(frame, weights=(1,), share=0.3).toPandas()
        assert got["copies"].isin([0, 1]).all()
        assert abs(got[got["size"] == 20_000]["copies"].mean() - 0.3) < 0.1
        assert abs(got[got["size"] == 300]["copies"].mean() - 0.3) < 0.02
        if block > 300:
            sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
            assert (abs(sums["taken"] - sums["target"]) <= 3 * 300).all()


def test_words_are_kept_and_chances_too():
    draw = np.random.default_rng(5)
    words = np.sort(np.clip(draw.lognormal(5, 1, 400), 1, 20_000).astype(int))[::-1]
    words = np.r_[words.sum() * 5, words]  # the first is too long for the others
    for p in (0.3, 0.6):
        drawn = np.array([mixing.round_words(np.full(401, p), words, draw, 1) for _ in range(2000)])
        assert (drawn[:, 0] == p).all()
        assert np.allclose(drawn.mean(axis=0), p, atol=0.06)
        assert (abs(drawn[:, 1:] @ words[1:] - p * words[1:].sum()) < 0.005 * words[1:].sum()).all()
        assert (((drawn > 0) & (drawn < 1)).sum(axis=1) <= 2).all()


def test_mixed_documents(docs, none):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    sized = docs.select("doc_id", "source", mixing.size_in_words().alias("size"))
    assert mixed.count() == mixing.mix(sized).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(none).collect() == []


def test_languages(spark):
    draw = np.random.default_rng(2)
    stems = {"aa": ["thing", "ough", "wash", "by"], "bb": ["über", "schön", "ung", "zu"], "cc": ["ción", "mente", "los", "que"]}
    text = lambda lang, n: " ".join(draw.choice(stems[lang], n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    model = languages.train(spark.createDataFrame([*rows, (1, None, "aa"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(model.chances.sum(axis=1), 1)
    fresh = [(i, text(lang, 25), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    fresh += [(900, None, "und"), (901, "", "und"), (902, " 12 ... ?", "und"), (903, text("bb", 30_000), "bb")]
    fresh += [(904, text("aa", 150) + " " + text("cc", 60), "aa")]
    frame = spark.createDataFrame(fresh, "doc_id long, text string, truth string")
    got = languages.predict(frame.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(fresh)
    assert all(row["lang_pred"] == row["truth"] and 0 <= row["score"] <= 1 for row in got)
    both = next(row for row in got if row["doc_id"] == 904)
    assert both["n_langs"] == 2 and abs(both["score"] - 0.7) < 0.1


def test_languages_of_nothing(docs, none):
    model = languages.train(none)
    assert model.languages == []
    assert {r["lang_pred"] for r in languages.predict(docs, model).collect()} == {"und"}
    assert languages.predict(none, languages.train(docs)).collect() == []


def test_base_phrases(spark, docs, none):
    draw = np.random.default_rng(6)
    some = "under the MIT license, Apache License version 2 cc-by nc all rights reserved é zz".split()
    rows = [(i, " ".join(draw.choice(some, draw.integers(0, 30))), "en", "s", 0) for i in range(300)]
    rows += cases.rows()
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, cases.DOCS)).collect()}
    for i, text, *_ in rows:
        seen = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.ascii_lower(text or ""))
        places, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            own = phrase.split()
            at = [k for k in range(len(seen)) if seen[k : k + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        if i is None or sum(r[0] == i for r in rows) > 1:
            continue
        row = got[i]
        assert (row["n_words"], row["n_base"]) == (len(seen), len(places))
        assert row["first_word"] == min(places, default=None)
        assert row["last_word"] == max(places, default=None)
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert licences.scan_licences(none).collect() == []


def test_matching_statistics_and_chains():
    wordings = {"x": ["a b c d e f g h i j"], "y": ["c d e k"]}
    automaton = licences.Automaton(wordings, {"d e": "p"})
    words = b"q a b c d e z f g h i j".split()
    phrases, matches = automaton.scan(words)
    assert phrases == [(4, 5, "p")]
    assert [(end, length) for _, end, length in matches] == [(5, 5), (11, 5)]
    assert automaton.spans(matches) == [("x", 1.0, 1, 11)]
    # The longest run that ends at each word, by trying all of them.
    draw = np.random.default_rng(8)
    runs = {tuple(t.split()[i:j]) for ts in wordings.values() for t in ts for i in range(10) for j in range(i + 1, 11)}
    for _ in range(200):
        text = draw.choice(list("abcdefghijkz"), 30).tolist()
        longest = [max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(30)]
        ends = [(i, n) for i, n in enumerate(longest) if n >= licences.LEAST_SHORT and (i == 29 or longest[i + 1] != n + 1)]
        got = automaton.scan([w.encode() for w in text])[1]
        assert [(end, n) for _, end, n in got] == ends


GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU"
    " {1}General Public License as published by the Free Software Foundation, either version {2}"
    " of the License, or (at your option) any later version."
)
MIT = licences.WORDINGS["mit"][0]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("licensed under the gnu general public license version 2", ""),
        ("licensed under the GNU Lesser General Public License version 3", ""),
        ("licensed under the GNU Affero General Public License version 3", ""),
        (GNU.format("program", "", "2"), ""),
        (GNU.format("library", "Lesser ", "2.1"), ""),
        (GNU.format("library", "Lesser ", "3"), ""),
        (GNU.format("program", "Affero ", "3"), ""),
        ("licensed under the Apache License, Version 1.1", ""),
        (MIT.replace("deal in", "deal with"), ""),
        ("licensed under the gnu general public license version 3", "gpl-3"),
        ("licensed under the GNU General Public License (GPL) version 3", "gpl-3"),
        (GNU.format("program", "", "3"), "gpl-3"),
        (GNU.format("program", "", "2") + " Or: " + GNU.format("code", "", "3"), "gpl-3"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        (MIT, "mit"),
        ("released under the MIT-derived Acme Proprietary Terms", ""),
        ("released under the MIT Press editorial policy", ""),
        ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: MIT-0", "mit-0"),
        ("SPDX-License-Identifier: LGPL-3.0-only", ""),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("SPDX-License-Identifier: BSD-4-Clause", ""),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ""),
        ("Mozilla Public License, version 1.1", ""),
        *((t, label) for label, texts in licences.WORDINGS.items() for t in texts),
    ],
)
def test_licences_and_their_near_misses(text, label):
    known = licences.WORDINGS, licences.PHRASES, licences.DISTINGUISHING
    got = licences.scan_text(licences.Automaton(*known), f"File a.c. {text} (end)")
    assert got[5] == label
    assert (got[6] > 0) == bool(label)


def test_spans_compete_where_they_overlap():
    longer = "creative commons attribution noncommercial sharealike"
    shorter = "creative commons attribution noncommercial"
    known = licences.WORDINGS, licences.PHRASES, licences.DISTINGUISHING
    for text in (f"{longer} file {shorter}", f"{shorter} file {longer}"):
        got = licences.scan_text(licences.Automaton(*known), text)
        assert got[5] == "cc-by-nc,cc-by-nc-sa"
    draw = np.random.default_rng(8)
    for _ in range(200):
        spans = [("x", int(draw.integers(1, 5)), 1.0, a := int(draw.integers(40)), a + int(draw.integers(9))) for _ in range(12)]
        plain: list = []
        for span in sorted(spans, key=lambda s: -s[1]):
            if all(k[1] == span[1] or k[4] < span[3] or k[3] > span[4] for k in plain):
                plain.append(span)
        assert sorted(licences.strongest(spans)) == sorted(plain)


def test_distinguishing_words_are_used(spark):
    texts = [GNU.format("program", "", "2"), GNU.format("program", "", "3")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan_licences(frame).collect()}
    assert got == {0: ("", 0.0), 1: ("gpl-3", 1.0)}


@pytest.mark.parametrize("cell", [4096, 40])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL_VECTORS", cell)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(9, 8))
    data = [(centre[i % 9] + draw.normal(size=8) * 0.25).tolist() for i in range(260)]
    rows = [(1000 - i, v, i % 3) for i, v in enumerate(data)] + [(i, data[5], 5 % 3) for i in range(40)]
    odd = [None, [], [0.0] * 8, [float("nan"), *data[0][1:]], [None, *data[0][1:]], [float("inf"), *data[0][1:]]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, data[0], None), (3001, [1e-200] * 8, 1), (3002, [1e200] * 8, 1), (3003, data[0][:5], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame.withColumn("head", F.lit(1))).collect()}
    assert len(got) == len(rows)
    usable = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    units = []
    for r in usable:
        v = np.array(r[1]) / max(map(abs, r[1]))
        units.append(v / np.linalg.norm(v))
    links = [
        (a[0], b[0]) for x, a in enumerate(usable) for y, b in enumerate(usable[:x])
        if a[2] == b[2] and len(a[1]) == len(b[1]) and units[x] @ units[y] >= 0.93
    ]
    expected = cases.smallest_reachable([r[0] for r in rows], links)
    degree: dict[int, int] = {}
    for pair in links:
        for i in pair:
            degree[i] = degree.get(i, 0) + 1
    for i, row in got.items():
        assert (row["n_links"], row["component_id"]) == (degree.get(i, 0), expected[i]), i
        assert row["kept"] == (i == expected[i])


def test_vectors_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(frame).collect() == []


def sharded(frame, shards, **more):
    keyed = frame.withColumns(
        {"h": F.xxhash64(F.coalesce("text", F.lit(""))), "size": F.octet_length(F.coalesce("text", F.lit(""))) + 8}
    )
    return histogram.shard(keyed.withColumn("slot", F.lit("clash")), "h", "doc_id", "size", shards, **more).toPandas()


@pytest.mark.parametrize("range_bytes", [1 << 30, 400])
def test_shards(spark, range_bytes):
    draw = np.random.default_rng(9)
    rows = [(i, "x" * int(draw.integers(0, 90)), "en", "s", 0) for i in range(900)]
    rows += [(1000 + i, "hot" * 20, "en", "s", 0) for i in range(500)]
    got = sharded(spark.createDataFrame(rows, cases.DOCS).repartition(4), 6, range_bytes=range_bytes)
    assert sorted(got["doc_id"]) == [r[0] for r in rows]
    size = got.groupby("shard")["size"].sum()
    groups = got.groupby("text")["size"].sum()
    shard = got["size"].sum() // 6
    most = groups[groups <= shard].max()  # boundaries move by half of such a group
    assert len(size) == 6 and size.max() - size.min() <= 2 * most + 0.01 * size.mean()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    cut = got.groupby("text")["shard"].nunique()
    assert set(cut[cut > 1].index) == set(groups[groups > shard].index) == {"hot" * 20}


@pytest.mark.parametrize("range_bytes", [1 << 30, 300])
@pytest.mark.parametrize("seed", range(3))
def test_boundaries_are_the_nearest_ones_between_groups(spark, seed, range_bytes):
    """Against a plain walk over the sorted groups; none of them is larger than a shard."""
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(40)) - 20, int(draw.integers(8, 60))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, h long, size long").repartition(3)
    got = histogram.shard(frame, "h", "doc_id", "size", 5, 0, range_bytes).toPandas()
    total = sum(r[2] for r in rows)
    ends = [sum(r[2] for r in rows if r[1] < h) for h in range(-21, 22)]
    below = got.groupby("shard")["size"].sum().reindex(range(5), fill_value=0).cumsum()
    for j in range(1, 5):
        want = total * j // 5
        assert abs(below[j - 1] - want) == min(abs(end - want) for end in ends)
    assert (got.groupby("h")["shard"].nunique() == 1).all()
    ordered = got.sort_values(["h", "doc_id"])
    assert ordered["shard"].is_monotonic_increasing
    for _, own in ordered.groupby("shard"):
        assert own["slot"].tolist() == list(range(len(own)))


def test_shards_of_odd_rows(docs, none):
    got = sharded(docs, 4)
    assert len(got) == len(cases.rows())
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert sharded(none, 4).empty


def test_rows_below_probes():
    first, second = np.array([-5, 3, 3, 3, 9]), np.array([0, -2, 4, 4, 1])
    keys = [histogram._joined(a, b) for a, b in zip(first.tolist(), second.tolist(), strict=True)]
    probes = sorted({k + d for k in keys for d in (-1, 0, 1)})
    assert histogram.below(first, second, probes).tolist() == [sum(k < p for k in keys) for p in probes]


def test_held_out_rule(docs):
    from maillode.llm.queries import held_out

    for row in docs.filter("doc_id IS NOT NULL").select("doc_id", held_out().alias("h")).collect():
        assert row["h"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)


def test_mixed_documents_by_place(spark, tmp_path):
    """Rows without ids, repeated rows and rows from one place keep the words that mix() takes."""
    rows = [(None if i % 3 else i, f"w{i % 2} " * (i % 4 + 1), "en", f"s{i % 3}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, cases.DOCS).withColumn("copies", F.lit(7))
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    twice = read.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    for table, n in ((docs, 1), (read, 1), (twice, 2)):
        got = mixing.mixed_documents(table)
        assert got.columns == docs.columns
        words = F.sum(mixing.size_in_words())
        total = table.agg(words).first()[0]
        assert abs(got.agg(words).first()[0] - 1.5 * total) <= 0.1 * total
        most = got.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", "source")]).count()
        assert most.filter(f"`coalesce(CAST(doc_id AS STRING), )` <> '' AND count > {2 * n}").isEmpty()
        again = sorted(map(str, mixing.mixed_documents(read).collect()))
        assert again == sorted(map(str, mixing.mixed_documents(read).collect()))
