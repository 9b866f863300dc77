"""Tokens of two tokenizers, aligned, against intervals compared one by one."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from maillode.llm import alignment
from maillode.llm.queries import vocabulary

from . import cases

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a▁b x", "x <|endoftext|> y<s> <0x41>", "naïve ﬁ Ⅷ \x85 \x1c z 日本語 🎉", " ", "  a  b \n\n c  ",
       "word" * 300, "\n\tx", "tab\there", "a a a a"]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(vocabulary(A), vocabulary(B))


def intervals(ids, widths):
    out, at = [], 0
    for one in ids:
        out.append((at, at + len(widths[one]), one))
        at += len(widths[one])
    return out


def brute(own, text):
    """Groups as text and all links, from the interval of each token."""
    if not text:
        return "", []
    whole = f" {text}".encode()
    a = own.a.encode(f" {text}", add_special_tokens=False).ids
    b = own.b.encode(text)
    b_bytes = []
    for i in range(own.n_b):
        piece = own.b.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    if b"".join(own.a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
        return "", []
    left, right = intervals(a, own.a_bytes), intervals(b, b_bytes)
    links = [
        (x, y) for s, e, x in left for t, f, y in right if max(s, t) < min(e, f)
    ]
    groups, start = [], 0
    for end in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
        sides = (
            ",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (left, right)
        )
        groups.append("|".join(sides))
        start = end
    return ";".join(groups), links


def expected(own, texts):
    each = [brute(own, text) for text in texts]
    docs = Counter(pair for _, links in each for pair in set(links))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups, links in each:
        sides = [group.split("|") for group in groups.split(";")] if groups else []
        out.append(
            (
                sum(len(s[0].split(",")) for s in sides), sum(len(s[1].split(",")) for s in sides),
                len(sides), len(links), sum(docs[p] == best[p[0]] for p in links),
                sum(docs[p] for p in links),
                hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            )
        )
    return out


def found(frame):
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return [(r["doc_id"], *(r[name] for name in names)) for r in frame.collect()]


# Few pairs shipped: the others' counts are joined.
@pytest.mark.parametrize("shipped", [1 << 20, 20, 1])
def test_against_brute_force(spark, own, monkeypatch, shipped):
    monkeypatch.setattr(alignment, "SHIPPED", shipped)
    rows = [r for r in cases.rows() if len(r[1] or "") < 2000]
    rows += [(100 + i, text, None, None, 0) for i, text in enumerate([*ODD, ODD[-1]])]
    docs = spark.createDataFrame(rows, cases.DOCS).repartition(3)
    got = found(alignment.aligned_documents(docs, vocabulary(A), vocabulary(B)))
    want = [(row[0], *one) for row, one in zip(rows, expected(own, [r[1] for r in rows]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_groups_are_an_output(spark, own):
    texts = ["Hello wörld, this is alignment.", None, "", ODD[2]]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, doc_id int")
    got = alignment.align(docs, vocabulary(A), vocabulary(B)).collect()
    assert {r["doc_id"]: r["groups"] for r in got} == {
        i: brute(own, t)[0] for i, t in enumerate(texts)
    }
    links = Counter(brute(own, texts[0])[1])
    row = next(r for r in got if r["doc_id"] == 0)
    codes, times = alignment.unpacked(row["codes"], row["times"])
    assert {divmod(c, own.n_b): t for c, t in zip(codes, times, strict=True)} == links


def test_twins_have_the_same_bytes(own):
    twins = [(a, int(code) % own.n_b) for a, code in enumerate(own.twin_codes) if code >= 0]
    assert len(twins) > 10_000
    assert all(own.a_bytes[a] == own.b_bytes[b] for a, b in twins)


def test_pieces_beyond_memory(own, monkeypatch):
    texts = ["one two three one", "two " + "x" * 100 + " four", None, "one"]
    want = [groups for groups, _, _ in own.documents(texts)]
    small = alignment.Aligner(vocabulary(A), vocabulary(B))
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    for _ in range(2):
        assert [groups for groups, _, _ in small.documents(texts)] == want
        assert len(small.known) <= 2


def test_empty_table(spark, none):
    assert found(alignment.aligned_documents(none, vocabulary(A), vocabulary(B))) == []


def test_other_columns_do_not_disturb(spark):
    row = spark.createDataFrame([(1, "a b", 9, 9, "x")], "doc_id long, text string, n_a int, row int, code string")
    assert found(alignment.aligned_documents(row, vocabulary(A), vocabulary(B)))[0][1:5] == (2, 2, 2, 2)
