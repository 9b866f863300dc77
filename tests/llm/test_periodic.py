"""Runs, against all periods tried one by one."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from maillode.llm import periodic

from . import cases


def brute(word, least=24, periods=3):
    n, out = len(word), []
    for p in range(1, n // periods + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and word[j] == word[j + p]:
                j += 1
            length = j - i + p
            smallest = not any(
                all(word[k] == word[k + q] for k in range(i, i + length - q)) for q in range(1, p)
            )
            if j > i and length >= max(least, periods * p) and smallest:
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda run: (run[0], run[2]))


def periodic_word(rng, n, letters, planted):
    word = [rng.randrange(letters) for _ in range(n)]
    for _ in range(planted):
        if n > 30:
            a = rng.randrange(n - 20)
            p, e = rng.randint(1, (n - a) // 3), rng.randint(a, n)
            word = [w if not a <= i < e else word[a + (i - a) % p] for i, w in enumerate(word)]
    return word


def test_all_runs_of_short_words(monkeypatch):
    monkeypatch.setattr(periodic, "LEAST_WORDS", 2)
    monkeypatch.setattr(periodic, "LEAST_PERIODS", 2)
    rng = random.Random(1)
    for _ in range(400):
        word = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 45))]
        assert periodic.runs_of(word) == brute(word, 2, 2)


def test_runs_through_stretches():
    rng = random.Random(2)
    some = 0
    for _ in range(250):
        word = periodic_word(rng, rng.randint(0, 260), rng.choice([1, 2, 50]), rng.randint(0, 3))
        got = periodic.word_runs([b"w%d" % w for w in word])
        assert got == brute(word)
        some += len(got)
    assert some > 100


def test_extensions():
    rng = random.Random(3)
    for n in (1, 2, 17, 90):
        word = [rng.randrange(2) for _ in range(n)]
        own = periodic.Extensions(word)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        want = []
        for i, j in pairs:
            k = 0
            while max(i, j) + k < n and word[i + k] == word[j + k]:
                k += 1
            want.append(k)
        if pairs:
            left, right = np.array(pairs).T
            assert own.common(left, right).tolist() == want
        suffixes = sorted(range(n + 1), key=lambda i: word[i:])
        assert [own.rank[i] for i in suffixes] == list(range(n + 1))
        suffixes = sorted(range(n + 1), key=lambda i: [-w for w in word[i:]])
        assert [own.opposite_rank[i] for i in suffixes] == list(range(n + 1))


def described(words):
    runs, dropped = brute(words), set()
    for start, length, period in runs:
        dropped.update(range(start + period, start + length))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)


@pytest.mark.parametrize("edited", [False, True])
def test_documents(spark, edited):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in cases.rows() if len(r[1] or "") < 3000]
    for i in range(100, 160):
        rows.append((i, " ".join(f"w{w}" for w in periodic_word(rng, 200, 9, i % 3))))
    rows += [(200, "a\x0bb c\x1cd " * 30), (201, "x " * 40), (201, "x " * 40), (202, "é\n" * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS start")
    found = periodic.describe_runs(periodic.find_runs(docs, edited=edited)).collect()
    names = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    want = []
    for i, text in rows:
        words = cases.WORD.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None and edited else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        want.append((i, *described(words)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], *(r[n] for n in names)) for r in found], key=key) == sorted(want, key=key)


def test_a_long_text_of_one_word():
    words = [b"again"] * 50_000
    assert periodic.word_runs(words) == [(0, 50_000, 1)]
    assert periodic.collapsed(words, [(0, 50_000, 1)]) == b"again"


def test_empty_table(spark, none):
    found = periodic.describe_runs(periodic.find_runs(none, edited=True))
    assert found.count() == 0 and "runs_sha256" in found.columns
