"""Case folding by built-in functions equals str.casefold() for every character."""

import sys

from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.operators import checks
from sieveline.operators.records import complete


def test_every_character(spark):
    affected = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and (c.casefold() != c or c.lower() != c)]
    rows = [(c,) for c in affected] + [(f"aB{c}ẞ-{c}İ",) for c in affected[::7]] + [("",), (None,), ("ΌΣΟΣ ﬃ Straße",), ("plain ASCII_Z",), ("é日本\U0001f600",)]
    df = spark.createDataFrame(rows, "s string").select("s", text.casefold(F.col("s")).alias("folded"))
    assert len(affected) > 1500 and all(r["folded"] == (r["s"] and r["s"].casefold()) for r in df.collect())


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "train", {"id": "Straße-1"}), (2, "test", {"id": "STRASSE_1"})], "row_seq long, pool string, identifiers map<string,string>").repartition(2)
    found = checks.near_duplicate_identifiers(complete(df.withColumn("raw_identifiers", F.col("identifiers"))), unicode=True)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["key"], r["identifiers"]) for r in found.collect()] == [("strasse1", 2)]
