"""The audit of sources against plain counting, and its tries against sorted lists."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import divergence as D


def plain(rows, least, top):
    """(text, lang, source) -> the sorted result."""
    docs, counts, groups = Counter(), Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        v = len(kept)
        p = lambda n, whole: 1 + 10**9 * (n + 5) // (whole + 5 * v)
        mine = {s: {t: p(counts[lang, s, t], total[s]) for t in kept} for s in sources}
        every = {t: p(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(mine[s][t] - mine[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(every[t] - mine[s][t], t.encode()) for t in kept if counts[lang, s, t] and mine[s][t] > every[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, df, **options):
    return sorted(map(tuple, D.audit(spark, df, **options).collect()))


def made(n, seed):
    r = random.Random(seed)
    words = ["", "a", "ab", "abc", "abd", "b", "é", "éa", "ÉA", "zZ", "Ab", "日本", "日本語", "x" * 300, "w1x", "naïve x", "\U0001f600"] + [f"t{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9)]
    pick = lambda: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=r.randint(0, 40)))
    rows = [(pick(), r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "S1", "ü", "", None])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "fr", "only"), ("--- 12", "it", "p"), ("q", "it", "r"), ("A-b_c" * 2000, "en", "s1")] + rows[:5]


@pytest.mark.parametrize("least", [1, 5, 30])
def test_as_plain(spark, least):
    rows = made(260, least)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, item string").repartition(6)
    assert found(spark, df, least=least, top=7) == plain(rows, least, 7)


def test_in_small_pieces(spark, monkeypatch):
    """Tries sent often, chunks of few leaves, many ranges, few cells, long texts in segments."""
    for name, value in {"LEAVES": 20, "TERMS": 40, "BUFFER": 30, "CHUNK": 3, "RANGE": 10, "CELLS": 40, "SEGMENT": 64}.items():
        monkeypatch.setattr(D, name, value)
    rows = made(150, 9)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert found(spark, df, least=3, top=4) == plain(rows, 3, 4)


def test_nothing(spark, empty):
    assert found(spark, empty) == []


def test_tries():
    r = random.Random(4)
    words = [bytes(r.choices(b"ab\xc3\xa9", k=r.randint(0, 9))) for _ in range(3000)]
    trie, want = D.Trie(), Counter(words)
    for w in words:
        leaf = trie.leaf(w)
        leaf[0] += 1
        leaf[1]["s"] = leaf[1].get("s", 0) + 2
    assert trie.size == len(want) and [(t, *x) for t, x in trie.walk()] == [(t, want[t], {"s": 2 * want[t]}) for t in sorted(want)]
    got, bounds = [], [b"", b"a", b"ab\xc3", b"abab", b"b", b"b" * 20, b"\xa9", None]
    for bound in bounds:
        some = [t for t, _ in trie.drain(bound)]
        assert bound is None or all(t < bound for t in some)
        got += some
        assert trie.size == len(want) - len(got)
    assert got == sorted(want)
    leaves = [(t, [want[t], {"x": 1, "yy": want[t]}]) for t in sorted(want)]
    rows = [dict(zip(["lang", "first", "last", "leaves", "sources", "words", "body"], row, strict=True)) for row in D.chunked("en", iter(leaves))]
    again = D.Trie()
    for row in rows:
        D.merge_chunk(again, row)
    assert list(again.walk()) == leaves and sum(row["words"][row["sources"].index("x")] for row in rows) == len(want)


def test_depths():
    words = sorted({b"", b"a", b"ab", b"\xc3\xa9", b"x" * 70, b"x" * 70 + b"y", b"x" * 200 + b"y", b"x" * 200 + b"z"})
    at = np.cumsum([0, *map(len, words)])
    found = D.depths(np.frombuffer(b"".join(words), np.uint8), at)
    assert found.tolist() == [0, *(D.shared(a, b) for a, b in zip(words, words[1:], strict=False))]


def test_exact_beyond_64_bits():
    n = np.array([[10**12, 3], [2**40, 0]])
    whole = np.array([3 * 10**13 + 7, 5 * 10**12 + 1])
    assert D.shares(n, whole).tolist() == [[1 + 10**9 * (int(c) + 5) // int(w) for c, w in zip(row, whole, strict=True)] for row in n]
