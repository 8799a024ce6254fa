"""Pages of rows and totals by sets of dimensions against plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from sieveline.operators import pages, totals
from sieveline.operators.records import complete


def test_pages_of_hot_and_small_keys(spark):
    """A key with most rows, null keys, keys with one row; no page is too long, all rows are there in order."""
    rows = [("hot" if k % 10 else f"k{k % 70}", None if k % 4 else "x", k * 3) for k in range(20_000)] + [(None, None, 1), (None, None, 4)]
    df = spark.createDataFrame(rows, "a string, b string, seq long").repartition(7)
    want: dict = {}
    for a, b, s in rows:
        want.setdefault((a, b), []).append(s)
    found = pages.paged(df, ["a", "b"], "seq", F.col("seq"), 300).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r["page"]):
        mine = got.setdefault((r["a"], r["b"]), [])
        assert r["first"] == len(mine) == 300 * r["page"] and 0 < len(r["rows"]) <= 300
        mine += r["rows"]
    assert got == {k: sorted(v) for k, v in want.items()}
    assert pages.paged(df.limit(0), ["a", "b"], "seq", F.col("seq")).count() == 0


def test_tasks_grow_with_rows(spark, monkeypatch):
    """Neither a range nor a task that makes pages holds more rows as these become more, whatever the session's partitions."""
    monkeypatch.setattr(pages, "RANGE", 1000, raising=False)
    df = spark.range(12_000).select(F.lit("hot").alias("value"), "id")
    found = pages.paged(df, ["value"], "id", F.col("id"), 100)
    assert found.rdd.getNumPartitions() == 13 and found.count() == 120
    assert found.agg(F.max(F.size("rows")), F.sum(F.size("rows"))).first()[:] == (100, 12_000)


def test_kinds_of_conflicts_without_copies_of_rows(spark):
    """What tells structures apart, nulls among them, in a plan that does not expand rows."""
    from sieveline.operators import checks

    part = [("a", "S1", "K-1", "K-1", "x"), ("a", None, None, "K-1", "x"), ("b", "S1", "K-1", "P-1", "y"), ("b", "S2", "K-2", "P-1", "y"), ("c", "S1", "K-1", "P-1", None), ("c", "S3", "L-1", "Q-1", None), ("d", None, None, None, None), ("d", "S2", "K-2", "P-1", "y")]
    df = spark.createDataFrame([(k, "n", i, *r) for k, (i, *r) in enumerate(part)], "row_seq long, id_column string, identifier string, canonical_smiles string, inchikey string, parent_inchikey string, tautomer_key string").withColumn("parse_error", F.lit(None).cast("string"))
    found = checks.conflicting_identifiers(df)
    assert {r["identifier"]: (r["conflict_type"], r["structures"]) for r in found.collect()} == {"a": ("salt_form", 2), "b": ("salt_form", 2), "c": ("different_compound", 2), "d": ("different_compound", 2)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    shared = checks.shared_compounds(df)
    assert "Expand" not in shared._jdf.queryExecution().optimizedPlan().toString()
    assert {r["compound_key"]: (r["identifiers"], r["conflict_type"]) for r in shared.collect()} == {"P": (3, "salt_form")}


def test_a_value_of_a_million_rows(spark):
    df = spark.range(1_050_000).select(F.when(F.col("id") % 21 == 0, F.col("id")).otherwise(-1).alias("value"), "id")
    sizes = pages.paged(df, ["value"], "id", F.col("id")).where("value = -1").select("page", F.size("rows").alias("n"), F.element_at("rows", 1).alias("r")).collect()
    assert len(sizes) == 100 and {x["n"] for x in sizes} == {10_000} and all(x["r"] == x["page"] * 10_500 + 1 for x in sizes)


def test_totals_are_zero_filled(spark):
    rows = spark.createDataFrame([], "row_seq long, pool string, raw_identifiers map<string,string>, identifiers map<string,string>")
    for check in (False, True):
        found = totals.totals(complete(rows), ["id"], check=check).collect()
        assert sorted(r["path"] for r in found) == sorted(totals.expected(["id"], check)) and not any(r["value"] for r in found)


def test_totals_by_pool(spark):
    part = [(k, "test" if k % 3 == 0 else "train", f"C{k % 5}", {"id": f"n{k % 4}"}, None if k % 7 else "bad", None if k % 7 else ["empty", "valence"][k % 2], f"K{k % 5}-A", k % 2 == 0) for k in range(40)]
    df = spark.createDataFrame(part, "row_seq long, pool string, raw_smiles string, identifiers map<string,string>, parse_error string, parse_error_category string, inchikey string, is_mixture boolean")
    df = complete(df.withColumn("raw_identifiers", F.col("identifiers")).withColumn("source_file", F.lit("f")).withColumn("row_index", F.col("row_seq")))
    found = {tuple(r["path"]): r["value"] for r in totals.totals(df, ["id"]).collect()}
    pool = Counter(r[1] for r in part)
    bad = [r for r in part if r[4]]
    assert found["total_train_rows",] == pool["train"] and found["total_test_rows",] == pool["test"] and found["total_unparseable",] == len(bad)
    assert {k[1]: v for k, v in found.items() if k[0] == "total_unparseable_by_category"} == Counter(r[5] for r in bad)
    assert found["total_unparseable_test",] == sum(r[1] == "test" for r in bad)
    for p in ("train", "test"):
        n = sum(r[7] and r[1] == p for r in part)
        assert found["total_mixtures", p] == n == found["total_quality_flags", "mixtures", p]
        assert found[f"total_internal_duplicates_{p}", "raw_smiles"] == sum(n > 1 for n in Counter(r[2] for r in part if r[1] == p).values())
    kinds = {k[3]: v for k, v in found.items() if "one_id_multiple_structures_by_type" in k}
    assert sum(kinds.values()) == found["total_identifier_namespace_issues", "id", "one_id_multiple_structures"] == 4
