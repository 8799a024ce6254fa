import random

import pytest

from sieveline.operators import nearest


def brute(sets):
    want = {}
    for i, (g, x) in enumerate(sets):
        for h, y in sets[:i]:
            if g is not None and g == h and x and y:
                want[g] = max(want.get(g, 0), len({*x} & {*y}) / len({*x} | {*y}))
    return want


@pytest.mark.parametrize("block", [3, 512])
def test_largest_similarity_of_groups(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    random.seed(7)
    # Groups of many sizes; "h" is a third of all; "z" shares nothing; "one" and "empty" have fewer than two sets.
    groups = random.choices("abcdefg", k=80) + ["h"] * 45
    sets = [(g, sorted(random.sample(range(60), random.randint(0, 20)))) for g in groups]
    sets += [("z", [1]), ("z", [2, 3]), ("one", [3]), ("one", []), ("empty", []), (None, [5, 6]), (None, [5, 6]), ("copies", [9]), ("copies", [9]), ("wide", [1 << 40, 7]), ("wide", [1 << 40, 7, 8])]
    sets += [("nested", list(range(k))) for k in range(1, 14)]
    df = spark.createDataFrame(sets, "g string, bits array<long>")
    got = {r["g"]: r["max_similarity"] for r in nearest.max_similarity(df, "g").collect()}
    assert got == brute(sets) and got["z"] == 0 and got["copies"] == 1 and got["wide"] == 2 / 3 and not {"one", "empty", None} & {*got}


def test_meetings_are_pruned_by_size(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    sets = [("g", list(range(k, 2 * k))) for k in range(1, 41)]
    rows = spark.createDataFrame(sets, "g string, bits array<int>").selectExpr("g", "bits", "size(bits) n")
    made, ends = nearest.blocks(rows, "g")
    met = lambda seed: nearest.meetings(made, ends, spark.createDataFrame([("g", seed)], "g string, seed double"), "g").count()
    blocks = made.count()
    assert met(0.0) == blocks * (blocks + 1) // 2 and met(0.9) < 3 * blocks
    got = nearest.max_similarity(rows.select("g", "bits"), "g").first()["max_similarity"]
    assert got == brute(sets)["g"]


def test_no_rows(spark):
    assert nearest.max_similarity(spark.createDataFrame([], "g int, bits array<int>"), "g").count() == 0
