"""Periodic runs against a comparison of all pairs of words."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sieveline.llm import runs as R


def plain(words):
    """Runs (start, length, period) of a list, by start, then period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def shorter(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(r, n):
    for _ in range(n):
        kind, size = r.randrange(5), r.randint(0, 90)
        words = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(size)]
        if kind == 1:
            unit = [r.choice("abcd") for _ in range(r.randint(1, 30))]
            words = words[:20] + unit * r.randint(1, 9) + words[20:]
        elif kind == 2:
            unit = (["x"] * r.randint(1, 9) + ["y"]) * r.randint(1, 5)
            words = unit * r.randint(1, 7) + words
        elif kind == 3:
            words = ["a"] * size + ["b"] + ["a"] * size
        elif kind == 4:
            a, b = ["0"], ["0", "1"]
            while len(b) < size:
                a, b = b, b + a
            words = [x for w in b for x in [w] * r.choice([1, 1, 1, 6])]
        yield words


@pytest.mark.parametrize("top", [3, 12])
def test_as_plain(monkeypatch, top):
    monkeypatch.setattr(R, "TOP", top)
    r = random.Random(top)
    every = list(texts(r, 900))
    for k in range(0, len(every), 9):
        some, known = every[k : k + 9], R.Numbers()
        ids = [R.numbers_of(" ".join(w).encode(), known) for w in some]
        found = R.runs_of(ids, len(known))
        assert [found.get(i, []) for i in range(len(some))] == [plain(w) for w in some]


def test_long_runs():
    """Runs longer than the longest names, and very many hits in one."""
    r = random.Random(2)
    unit = [str(r.random()) for _ in range(7001)]
    for words in (["a"] * 300_000, ["a", "b", "c"] * 50_000 + ["x"] + ["a", "b"] * 30_000, unit * 5 + unit[:17] + ["z"] + ["q"] * 50):
        known = R.Numbers()
        ids = R.numbers_of(" ".join(words).encode(), known)
        found = R.runs_of([ids], len(known))[0]
        if words[0] == "a" and words[1] == "a":
            assert found == [(0, 300_000, 1)]
        elif words[0] == "a":
            assert found == [(0, 150_000, 3), (150_001, 60_000, 2)]
        else:
            assert found == [(0, 5 * 7001 + 17, 7001), (5 * 7001 + 18, 50, 1)]


def rows_of(r):
    rows = [(k, " ".join(w), "x") for k, w in enumerate(texts(r, 300))]
    odd = [None, "", " \t\n\x0b\x0c\r", "one", "a a a a a a", "A a a a a a a", "é é é é " * 4, "日 本 " * 9, "a\x1cb a\x1cb " * 5, "z " * 30_000]
    return rows + [(1000 + k, t, "y") for k, t in enumerate(odd)] + rows[:4] + [(None, "k k k k k k k", "n")]


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(R, "TOGETHER", 700)
    monkeypatch.setattr(R, "SEGMENT", 64)
    rows = rows_of(random.Random(5))
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, runs string, n_words int").repartition(4)
    want = []
    for i, t, label in rows:
        words = words_of(t)
        found = plain(words) if len(words) < 9999 else [(0, 30_000, 1)]
        want.append((i, t, label, 5, len(words), found, shorter(words, found)))
    got = [(*x[:5], [tuple(r) for r in x["runs"]], x["collapsed"]) for x in R.find_runs(spark, df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert R.find_runs(spark, df).columns == ["doc_id", "text", "runs_input", "n_words_input", "n_words", "runs", "collapsed"]


def test_planted_and_digests(spark, docs, rows):
    rows = [(r[0], r[1]) for r in rows] + rows_of(random.Random(6))[:290:7] + [(None, "a b c"), (20, None)]
    got = R.digests(R.find_runs(spark, R.planted(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")))).collect()
    want, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows:
        words, h = words_of(t), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        found = plain(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((i, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(shorter(words, found))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(1 for w in want if w[1]) > 20


def test_nothing(spark, empty):
    assert R.find_runs(spark, empty).count() == 0
    assert R.runs_of([], 0) == {} and R.runs_of([np.zeros(0, np.int64)], 0) == {}
