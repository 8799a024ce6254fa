"""Both routes of the similarity join, and what picks one, against comparing all pairs."""

import random

import pytest

from sieveline.operators import bitblocks, similarity


def made(r, n, width):
    base = [set(r.sample(range(width), r.randint(1, width // 2))) for _ in range(8)]
    rows = []
    for _ in range(n):
        bits = set(r.choice(base))
        for _ in range(r.choice([0, 1, 3, 9])):
            bits ^= {r.randrange(width)}
        rows.append(sorted(bits))
    return [*rows, [], [0], [width - 1], list(range(width)), rows[0], rows[0]]


@pytest.mark.parametrize("block", [7, 4096])
def test_routes(spark, monkeypatch, block):
    monkeypatch.setattr(bitblocks, "BLOCK", block)
    monkeypatch.setattr(bitblocks, "STRIP", 5)
    r = random.Random(block)
    x, y = made(r, 60, 70), made(r, 40, 70)
    left = spark.createDataFrame([(f"x{k}", b) for k, b in enumerate(x)], "a string, bits array<int>").repartition(3)
    right = spark.createDataFrame(list(enumerate(y)), "b long, bits array<int>").repartition(3)
    for t in (0.0, 0.34, 0.75, 1.0):
        want = []
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                common, union = len(set(p) & set(q)), len(set(p) | set(q))
                if p and q and common / union >= t:
                    want.append((f"x{i}", j, common, union))
        for route in ("blocks", None) if t == 0 else ("blocks", "prefix", None):
            got = similarity.similar_pairs(left, right, t, route)
            assert got.columns == ["a", "b", "common", "union"] and sorted(map(tuple, got.collect())) == sorted(want), (t, route)


def test_choice(spark, monkeypatch):
    """Frequent bits go to blocks, rare ones and very wide sets to prefixes; a side without sets gives nothing."""
    asked = []
    monkeypatch.setattr(bitblocks, "similar", lambda *a: asked.append(a) or spark.createDataFrame([], "a long, b long, common int, union int"))
    monkeypatch.setattr(similarity, "JOINED_ROW", 1e-6)
    frame = lambda rows, k: spark.createDataFrame(list(enumerate(rows)), f"{k} long, bits array<int>")
    dense = [sorted({k % 7, (k * 3) % 7 + 7}) for k in range(200)]
    rare = [[k * 5, k * 5 + 1] for k in range(200)]
    similarity.similar_pairs(frame(dense, "a"), frame(dense, "b"), 0.3)
    assert len(asked) == 1
    assert similarity.similar_pairs(frame(rare, "a"), frame(rare, "b"), 0.3).count() == 200
    wide = [[k * 1_000_000, k * 1_000_000 + 1] for k in range(20)]
    assert similarity.similar_pairs(frame(wide, "a"), frame(wide, "b"), 0.3).count() == 20 and len(asked) == 1
    assert similarity.similar_pairs(frame([], "a"), frame(rare, "b"), 0.3).count() == 0


def test_sizes_that_allow():
    sizes = [{3: 2, 10: 5}, {1: 4, 3: 1, 6: 2, 20: 3}]
    for t in (0.0, 0.3, 0.5, 0.6, 1.0):
        want = sum(c * d for n, c in sizes[0].items() for m, d in sizes[1].items() if min(n, m) >= t * max(n, m))
        assert bitblocks.cells(sizes, t) == want


def test_unmatched(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a long, b long")
    left, right = spark.createDataFrame([(1, "s", None), (2, None, "p")], "a long, k_a string, m_a string"), spark.createDataFrame([(1, "s", "q"), (2, None, "p")], "b long, k_b string, m_b string")
    keep = lambda keys: sorted((r["a"], r["b"]) for r in similarity.unmatched(pairs, left, right, keys).collect())
    assert keep(["k"]) == [(1, 2), (2, 1), (2, 2)] and keep(["k", "m"]) == [(1, 2), (2, 1)]
