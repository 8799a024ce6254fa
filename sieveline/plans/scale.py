"""Queries over the operators that are made for large groups and large files, with the same in SQL."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, similarity
from ..sources import delimited
from ..sources.shared import shared_dir

FILES = 8
PIECE = 32 << 20  # bytes of text that a task writes


def delimited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, written as CSV files by doc_id modulo 8 and read back in ranges of 1 MB, with file and row number.

    A file is written in pieces by ranges of doc_id, so that no task writes a whole file.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    folder = f"{shared_dir(spark)}/delimited-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = docs.withColumn("file", (F.col("doc_id") % FILES).cast("int")).repartitionByRange(FILES + size // PIECE, "file", "doc_id")
    dealt.sortWithinPartitions("file", "doc_id").write.partitionBy("file").csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0").select("path").collect()  # a row a piece
    pieces: dict[int | None, list[str]] = {}
    for path in sorted((r[0] for r in found), key=os.path.basename):  # their numbers follow the ranges
        k = re.search(r"/file=(-?\d+)?", path)[1]
        pieces.setdefault(k and int(k), []).append(path)
    read = None
    for k, paths in pieces.items():
        one = delimited.read(spark, paths, ",", ["doc_id", "source", "text"], 1 << 20).withColumn("file", F.lit(k).cast("int"))
        read = one if read is None else read.unionByName(one)
    if read is None:
        return docs.select(F.lit(0).alias("file"), F.lit(0).cast("long").alias("row_index"), "doc_id", "source", F.lit("").alias("text_md5")).limit(0)
    return read.select("file", F.col(delimited.INDEX).alias("row_index"), F.col("doc_id").cast("long"), "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def tanimoto_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: for every vector with an id divisible by 50, how many others have similar positive components and match it by neither
    of two keys, and the largest such similarity."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = v.select("vec_id", F.col("label").alias("skeleton"), F.when(F.col("vec_id") % 7 > 0, F.col("vec_id") % 11).alias("parent"),
        F.expr("filter(transform(embedding, (x, i) -> if(x > 0, i, -1)), x -> x >= 0)").alias("bits"))
    side = lambda df, x: df.select(F.col("vec_id").alias(x), F.col("skeleton").alias(f"skeleton_{x}"), F.col("parent").alias(f"parent_{x}"), "bits")
    left, right = side(rows, "a"), side(rows.where("vec_id % 50 = 0"), "b")
    pairs = similarity.similar_pairs(left.select("a", "bits"), right.select("b", "bits"), 0.5)
    found = similarity.unmatched(pairs, left.drop("bits"), right.drop("bits"), ["skeleton", "parent"]).where("a <> b")
    return found.groupBy("b").agg(F.count("*").alias("similar"), F.round(F.max(F.col("common") / F.col("union")), 9).alias("largest"))


def occurrence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line states and return flags that both pools have, with the rows of each in pages of 10,000: a state is on half of all rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    pool = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    loc = F.struct(row.alias("row_seq"), pool.alias("pool"), F.lit("lineitem").alias("source_file"), row.alias("row_index"), F.col("l_linestatus").alias("raw_smiles"))
    kinds = F.array(F.struct(F.lit("status").alias("representation"), F.col("l_linestatus").alias("value")), F.struct(F.lit("flag").alias("representation"), F.col("l_returnflag").alias("value")))
    long = rows.select(loc.alias("loc"), pool.alias("pool"), F.lit(None).cast("string").alias("inchikey"), kinds.alias("kinds"))
    long = long.select("loc", "pool", "inchikey", F.explode("kinds").alias("k")).select("loc", "pool", "inchikey", "k.*")
    keys = ["representation", "value"]
    found = checks.occurrence_pages(checks.overlap_groups(long, keys), long, keys)
    listed = F.md5(F.array_join(F.transform("occurrences", lambda o: o["row_index"].cast("string")), ","))
    return found.select(*keys, "train_rows", "test_rows", "page", F.size("occurrences").alias("rows"), listed.alias("rows_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "delimited_documents": delimited_documents,
    "tanimoto_unmatched": tanimoto_unmatched,
    "occurrence_pages": occurrence_pages,
}
ORACLE_SQL: dict[str, str] = {
    "occurrence_pages": """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS row, l_orderkey % 5 = 0 AS test, l_linestatus, l_returnflag FROM lineitem),
        k AS (SELECT 'status' AS representation, l_linestatus AS value, row, test FROM r UNION ALL SELECT 'flag', l_returnflag, row, test FROM r),
        n AS (SELECT representation, value, count(*) FILTER (NOT test) AS train_rows, count(*) FILTER (test) AS test_rows FROM k GROUP BY representation, value),
        p AS (SELECT representation, value, row, row_number() OVER (PARTITION BY representation, value ORDER BY row) - 1 AS place FROM k)
        SELECT representation, value, any_value(train_rows) AS train_rows, any_value(test_rows) AS test_rows, place // 10000 AS page, count(*)::INTEGER AS rows,
          md5(string_agg(row::VARCHAR, ',' ORDER BY row)) AS rows_md5
        FROM p JOIN n USING (representation, value) WHERE train_rows > 0 AND test_rows > 0 GROUP BY representation, value, place // 10000""",
    "delimited_documents": """SELECT (doc_id % 8)::INTEGER AS file, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS row_index,
        doc_id, nullif(source, '') AS source, md5(coalesce(text, '')) AS text_md5 FROM documents""",
    "tanimoto_unmatched": """WITH s AS (SELECT vec_id, label, CASE WHEN vec_id % 7 > 0 THEN vec_id % 11 END AS parent,
          list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
        e AS (SELECT vec_id, label, parent, len(bits) AS n, unnest(bits) AS bit FROM s)
        SELECT b, count(*) AS similar, round(max(common / "union"), 9) AS largest FROM (
          SELECT x.vec_id AS a, y.vec_id AS b, count(*) AS common, any_value(x.n) + any_value(y.n) - count(*) AS "union" FROM e AS x JOIN e AS y USING (bit)
          WHERE y.vec_id % 50 = 0 AND x.vec_id <> y.vec_id AND x.label IS DISTINCT FROM y.label AND (x.parent IS NULL OR y.parent IS NULL OR x.parent <> y.parent)
          GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.5) GROUP BY b""",
}
