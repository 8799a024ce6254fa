"""Mixing against a plain version that sorts documents by hash, and on the rows that break such things."""

import hashlib
import re
from fractions import Fraction

import pytest

from sieveline.llm import mixing


def plain(rows, weights=(1, 2, 3), ceiling=3, fillers=3):
    """(doc_id, text, source) -> sorted (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    digest = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    total: dict = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        unit = Fraction(sum(total.values()) - sum(ceiling * total[s] for s in capped), sum(weight[s] for s in free) or 1)
        more = {s for s in free if unit * weight[s] > ceiling * total[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in order:
        target = Fraction(ceiling * total[s]) if s in capped else unit * weight[s]
        mine = [(digest(i, t), size(t), i) for i, t, x in rows if x == s]
        copies = min(ceiling, int(target) // total[s]) if total[s] else 0
        left, taken = int(target) - copies * total[s], set()
        for k in range(1 + fillers):
            rest = [h for h in sorted({h for h, n, _ in mine if n and h not in taken and (not k or 4 * n <= left)})]
            for h in rest:
                words = sum(n for g, n, _ in mine if g == h)
                if words > left:
                    break
                taken.add(h)
                left -= words
        out += [(i, n, total[s], float(target), n * (copies + (n > 0 and h in taken))) for h, n, i in mine]
    return sorted(out, key=repr)


def found(spark, df):
    return sorted((tuple(r) for r in mixing.mix(spark, df).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def test_as_sorted(spark, docs, rows):
    assert found(spark, docs) == plain([(r[0], r[1], r[3]) for r in rows])


def test_odd_rows(spark, monkeypatch):
    """Null sources, ids and texts, copies, one source with most of the rows, sources at their ceiling; five levels."""
    monkeypatch.setattr(mixing, "STEP", 12)
    rows = [(k, "w " * (1 + k % 7), "big") for k in range(400)] + [(None, "a b c", None)] * 5 + [(900, None, "none"), (901, " \t\n", "none"), (902, "x", ""), (902, "x", "")]
    rows += [(1000 + k, "é ß y\x1cz", "über") for k in range(9)] + [(2000, "long " * 50_000, "zz"), (2001, "t", "zz"), (None, None, None)]
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, size string, target int").repartition(5)
    assert found(spark, df) == plain(rows)
    assert {"size_input", "target_input"} < set(mixing.mix(spark, df).columns)
    with pytest.MonkeyPatch.context() as m:  # the way without a broadcast
        m.setattr(mixing, "BROADCAST_SOURCES", 1)
        assert found(spark, df) == plain(rows)


def test_many_sources_and_reruns(spark):
    rows = [(k, "w " * (k % 50), f"s{k * 7919 % 301:03d}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = found(spark, df.repartition(7))
    assert first == plain(rows) and first == found(spark, df.repartition(2))
    assert all(t <= 3 * n for _, n, _, _, t in first)


def test_nothing(spark, empty):
    assert found(spark, empty) == []
    assert found(spark, spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")) == [(1, 0, 0, 0.0, 0)]
