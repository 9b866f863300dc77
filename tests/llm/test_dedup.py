"""Exact and near deduplication against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillode.llm import components, exact, near

from . import cases


def test_filters_merge_without_loss():
    draw = np.random.default_rng(5)
    parts = [draw.integers(0, 1 << 64, 4000, dtype=np.uint64) for _ in range(3)]
    parts.append(np.repeat(parts[0][:500], 3))
    blocks: dict[int, list] = {}
    for part in parts:
        for block, *arrays in exact.build(part, 7):
            blocks.setdefault(block, []).append(tuple(arrays))
    found = [exact.merge(block, slices, 7) for block, slices in sorted(blocks.items())]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (np.concatenate([f[0] for f in found]) == values).all()
    assert (np.concatenate([f[1] for f in found]) == counts).all()


def test_exact_marks(docs):
    rows = cases.rows()
    groups: dict[str, list] = {}
    for row in rows:
        groups.setdefault(row[1] or "", []).append(row[0])
    wider = docs.withColumns({"keep_id": F.lit("clash"), "_fp": F.lit(1), "more": F.lit(2)})
    got = exact.mark_copies(wider).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = groups[row["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (row["keep_id"], row["group_size"]) == (keep, len(ids))
        assert row["kept"] == (row["doc_id"] == keep)
        assert row["text_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
        assert row["more"] == 2


def test_equal_fingerprints_are_not_equal_texts(docs, monkeypatch):
    """With one fingerprint for all texts, the verification of bytes alone decides."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    sizes = {r["doc_id"]: r["group_size"] for r in exact.mark_copies(docs).collect()}
    assert sizes[10] == 3 and sizes[11] == 1


def test_exact_on_nothing(none):
    assert exact.mark_copies(none).collect() == []


def test_shingle_sets():
    random.seed(2)
    parts = ["a", "Bb", "é", "x", " ", "\n", "\t ", "  ", "\x0b"]
    texts = [None, "", " ", "a b c d e", "A B c D e"]
    texts += ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(150)]
    plain = []
    for text in texts:
        w = cases.words(text)
        plain.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    made = list(near.shingle_sets(texts))
    assert [len(m) for m in made] == [len(p) for p in plain]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(np.intersect1d(made[i], made[j])) == len(plain[i] & plain[j])


def test_pieces_of_a_batch_don_t_matter(monkeypatch):
    texts = [row[1] for row in cases.rows()]
    whole = list(near.shingle_sets(texts))
    monkeypatch.setattr(near, "HASH_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, near.shingle_sets(texts), strict=True))


def check_near(result, rows):
    texts = {row[0]: row[1] for row in rows if row[0] is not None}
    expected = cases.smallest_reachable(texts, cases.jaccard_links(texts))
    got = result.collect()
    assert len(got) == len(rows)
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
            continue
        assert row["component_id"] == expected[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] == row["component_id"])


def test_near_duplicates(docs):
    wider = docs.withColumns({"component_id": F.lit("clash"), "a": F.lit(1), "key": F.lit(2)})
    check_near(near.near_duplicates(wider), cases.rows())
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns


@pytest.mark.parametrize(("block", "most"), [(512, 8), (8, 8), (3, 1)])
def test_near_families(spark, monkeypatch, block, most):
    """Families around the threshold, in which few members are linked with the first one."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "MOST_BLOCKS", most)
    random.seed(4)
    rows = []
    for family in range(6):
        base = cases.sentence(family, 60).split()
        for member in range(25):
            own = list(base)
            for _ in range(member % 9):
                own[random.randrange(len(own))] = f"new{random.random()}"
            rows.append((len(rows), " ".join(own), "en", "s", 0))
        rows.append((len(rows), " ".join(base), "en", "s", 0))
    check_near(near.near_duplicates(spark.createDataFrame(rows, cases.DOCS)), rows)


def test_an_id_with_two_texts(spark):
    """Its links are those of both, whichever row is met first."""
    a, b, c = (cases.sentence(k, 40) for k in (1, 2, 3))
    texts = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (7, c), (5, c), (5, a), (9, c + " x")]
    for rows in (texts, texts[::-1], texts + texts):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {(r["doc_id"], r["component_id"]) for r in near.near_duplicates(docs).collect()}
        assert got == {(i, 1) for i in (1, 2, 3, 5, 7, 9)}


def look_alikes(n, changed=10):
    """``n`` texts that share most of their words with a base, and less with one another."""
    base = cases.sentence(3, 150).split()
    rows = []
    for member in range(n):
        own = list(base)
        for k in range(changed):
            own[(k * 15 + member % 7) % 150] = f"own{member}x{k}"
        rows.append((member, " ".join(own), "en", "s", 0))
    return rows


def test_a_bucket_of_look_alikes_without_links(spark, monkeypatch):
    """Three thousand texts of one bucket, none linked: they leave no rows to compare."""
    monkeypatch.setattr(near, "MOST_BLOCKS", 2)
    rows = look_alikes(3000)
    frame = spark.createDataFrame(rows, cases.DOCS)
    sets = list(near.shingle_sets([rows[0][1], rows[7][1], rows[1][1]]))
    assert not near.linked(sets[0], sets[1]) and not near.linked(sets[0], sets[2])
    full = near.full_sets(frame, frame.select("doc_id"))
    prefixes = near._prefixes(near._shingle_rows(full.withColumn("component", F.col("doc_id"))))
    assert prefixes.count() == 0
    got = near.near_duplicates(frame.repartition(4)).collect()
    assert len(got) == 3000 and all(r["component_id"] == r["doc_id"] for r in got)


def test_prefixes_lose_no_link(spark):
    """Sets around the threshold: any two that are linked meet in a key."""
    random.seed(8)
    sets = []
    for family in range(8):
        base = list(range(family * 1000, family * 1000 + 40))
        for _ in range(20):
            own = random.sample(base, random.randint(26, 40))
            sets.append(np.unique(np.array(own + random.sample(range(9000, 9030), 2), np.uint64)))
    rows = [(i, i, 5, bytearray(one.tobytes())) for i, one in enumerate(sets)]
    frame = spark.createDataFrame(rows, "doc_id long, component long, set_id long, shingles binary")
    met: dict[int, set[int]] = {}
    for r in near._prefixes(near._shingle_rows(frame)).collect():
        met.setdefault(r["key"], set()).add(r["doc_id"])
    pairs = {(x, y) for held in met.values() for x in held for y in held}
    true = [(x, y) for x in range(len(sets)) for y in range(x) if near.linked(sets[x], sets[y])]
    assert len(true) > 100 and set(true) <= pairs


def test_near_on_nothing(none):
    assert near.near_duplicates(none).collect() == []


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    links += [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(70)]
    random.shuffle(links)
    links = [pair if random.random() < 0.5 else pair[::-1] for pair in links]
    nodes = {i for pair in links if pair[0] != pair[1] for i in pair}
    frame = spark.createDataFrame(links, "p long, q long")
    got = {r["node"]: r["component"] for r in components.components(frame, "p", "q").collect()}
    assert got == cases.smallest_reachable(nodes, [p for p in links if p[0] != p[1]])
