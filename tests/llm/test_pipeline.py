"""The pipeline's stages against plain versions of what each decides, on few documents."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, words string"
WORDS = "the house stands near old river where many people walk every morning before their work begins and children play with small boats under green trees".split()


def rows_of(texts):
    return [(i, t, "en", "web", len(t or ""), "x", 1, "w") for i, t in texts]


def documents(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def test_near_duplicates_of_the_stage(spark):
    """Nulls, empty texts, repeated rows and null ids; clean documents and one of each group stay, no two kept ones are similar."""
    r = random.Random(3)
    base = [prose(r, 60) for _ in range(6)]
    near = base[0].split()
    near[30] = "bridge"
    texts = [*enumerate(base, 10), (20, base[1]), (21, " ".join(near)), (22, base[1].upper()), (12, base[2]), (30, None), (31, ""), (None, base[3])]
    got = pipeline.near_dedup(spark, documents(spark, texts), "")
    assert got.columns == pipeline.COLUMNS
    kept = [(x["doc_id"], x["text"]) for x in got.collect()]
    parts = {}
    for i, t in texts:
        if i is not None:
            like = [j for j in parts if t and parts[j] and len(shingles(t) & shingles(parts[j])) >= 0.8 * len(shingles(t) | shingles(parts[j]))]
            if not like:
                parts.setdefault(i, t)
    assert sorted((i, t) for i, t in kept if i is not None and t) == sorted((i, t) for i, t in parts.items() if t)
    assert (None, base[3]) in kept and (30, None) in kept and (31, "") in kept


def test_lines_of_the_stage(spark):
    r = random.Random(4)
    lines = [prose(r, 12) for _ in range(5)]
    texts = [(1, f"{lines[0]}\n{lines[1]}"), (2, f"{lines[1]}\n{lines[2]}"), (3, lines[0]), (4, lines[3]), (5, None), (6, "")]
    got = {x["doc_id"]: x for x in pipeline.line_dedup_stage(spark, documents(spark, texts), "").collect()}
    assert got[1]["text"] == texts[0][1] and got[2]["text"].strip() == lines[2] and got[2]["n_chars"] == len(got[2]["text"])
    assert 3 not in got and got[4]["text"] == lines[3] and got[5]["text"] is None and got[6]["text"] == ""


def test_whole_run(spark, tmp_path):
    """Rejects what has no letters, drops copies and what holds a benchmark item, and packs the rest without gaps; leaves an empty table empty.

    Each document has words of its own: lines whose sets of words are alike go, in whatever order their words stand.
    """
    r = random.Random(5)
    own = lambda k, n: " ".join(w + chr(97 + k) for w in r.choices(WORDS, k=n))
    good = [(k, own(k, 80)) for k in range(8)]
    item = own(20, 30)
    texts = [*good, (100, good[0][1]), (101, None), (102, "12345 678"), (103, ""), (104, f"{own(21, 40)} {item} {own(22, 10)}")]
    for folder, some in (("full", texts), ("empty", [])):
        documents(spark, some).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    placed = pipeline.run(spark, f"{tmp_path}/full")
    assert sorted({x["doc_id"] for x in placed.collect()}) == [k for k, _ in good]
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(x["n"] == x["end"] <= 4096 for x in used)
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
