"""Queries that bind the audit's operators to the driver's tables, with the same in SQL.

``mol`` is a molecule-like view of part; ``drawn_records`` parses it by string rules alone, so these bindings exercise the
relational operators and are no chemistry (sieveline.chem is).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, nearest, similarity
from ..operators.records import complete
from ..sources.shared import materialise, shared_dir
from . import molecules, scale, sink

MOL = """
  SELECT row_index, pool, source_file, name_id, code_id,
    CASE k WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'C1' || chain WHEN 3 THEN chain || '[R]' WHEN 4 THEN chain || '.[0.5H2O]'
      WHEN 5 THEN chain || '(' WHEN 6 THEN 'C' || chr(10) || chain || 'O' WHEN 7 THEN chain || 'N.Cl' WHEN 8 THEN chain || '[NH3+].[Cl-]'
      WHEN 9 THEN chain || 'N' WHEN 10 THEN 'N' || chain WHEN 11 THEN ' ' || chain || 'O' ELSE chain || 'O' END AS raw_smiles
  FROM (SELECT p_partkey AS row_index, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS pool,
      concat('part_', CAST(p_partkey % 3 AS VARCHAR(4)), '.csv') AS source_file, p_name AS name_id,
      CASE p_partkey % 4 WHEN 0 THEN concat('CPD-', CAST(p_partkey % 97 AS VARCHAR(8))) WHEN 1 THEN concat('cpd_', CAST(p_partkey % 97 AS VARCHAR(8)))
        WHEN 2 THEN concat(' CPD-', CAST(p_partkey % 97 AS VARCHAR(8))) ELSE NULL END AS code_id,
      repeat('C', 1 + p_size % 9) AS chain, p_partkey % 13 AS k FROM part) t"""

# The same view, record table and long forms for DuckDB, whose regular expressions have no lookahead.
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
SQL = f"""
WITH mol AS ({MOL}),
said AS (SELECT *, trim(raw_smiles, {WS}) AS s FROM mol),
judged AS (SELECT *, CASE
    WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '[\\x00-\\x1f\\x7f]|<NL>|<CR>|<TAB>') THEN 'control_characters'
    WHEN lower(s) IN ('0', 'na', 'n/a', 'nan', 'none', 'null', 'nil', '-', '--', '?', '.', 'not available') OR NOT regexp_matches(s, '[BCNOPSFIbcnops]') THEN 'placeholder'
    WHEN regexp_matches(s, '\\[R\\d*''?\\]|R([^a-z]|$)|\\[n=\\]|\\(CH2\\)n|\\[[XYQAG]\\]') THEN 'markush'
    WHEN regexp_matches(s, '\\[\\s*\\d+\\s*[./]\\s*\\d*[^\\]]*\\]') THEN 'stoichiometry_text'
    WHEN length(regexp_replace(s, '[^1]', '', 'g')) % 2 = 1 THEN 'ring_closure'
    WHEN right(s, 1) IN ('(', '[', '=', '#', '/', '\\', '-', '@', '.', '%') THEN 'truncated' END AS category FROM said),
keyed AS (SELECT *, CASE WHEN category IS NULL THEN replace(replace(s, '[NH3+]', 'N'), '[Cl-]', 'Cl') END AS canonical_smiles FROM judged),
halves AS (SELECT *, split_part(canonical_smiles, '.', 1) AS parent_smiles FROM keyed),
rec AS (SELECT *, array_to_string(list_sort(string_split(canonical_smiles, '')), '') || '-' || canonical_smiles AS inchikey,
    array_to_string(list_sort(string_split(parent_smiles, '')), '') || '-' || parent_smiles AS parent_inchikey FROM halves),
reps AS (SELECT pool, source_file, row_index, inchikey, representation, value FROM (
    SELECT *, 'raw_smiles' AS representation, nullif(raw_smiles, '') AS value FROM rec UNION ALL SELECT *, 'canonical_smiles', canonical_smiles FROM rec
    UNION ALL SELECT *, 'inchikey', inchikey FROM rec UNION ALL SELECT *, 'parent_inchikey', parent_inchikey FROM rec
    UNION ALL SELECT *, 'inchikey_connectivity', split_part(inchikey, '-', 1) FROM rec) WHERE value IS NOT NULL),
ids AS (SELECT *, nullif(trim(raw_value, {WS}), '') AS identifier FROM (
    SELECT *, 'name_id' AS id_column, name_id AS raw_value FROM rec UNION ALL SELECT *, 'code_id', code_id FROM rec)),
found AS (SELECT * FROM ids WHERE identifier IS NOT NULL),
over AS (SELECT representation, value, count(*) FILTER (pool = 'train') AS train_rows, count(*) FILTER (pool = 'test') AS test_rows
  FROM reps GROUP BY 1, 2 HAVING count(*) FILTER (pool = 'train') > 0 AND count(*) FILTER (pool = 'test') > 0
    AND (representation NOT IN ('parent_inchikey', 'inchikey_connectivity') OR count(DISTINCT coalesce(inchikey, chr(1))) > 1)),
dups AS (SELECT pool, representation, value, count(*) AS rows FROM reps GROUP BY 1, 2, 3
  HAVING count(*) > 1 AND (representation NOT IN ('parent_inchikey', 'inchikey_connectivity') OR count(DISTINCT coalesce(inchikey, chr(1))) > 1)),
conflicts AS (SELECT id_column, identifier, count(*) AS rows, count(DISTINCT (canonical_smiles, inchikey)) AS structures,
    CASE WHEN count(DISTINCT inchikey) = 1 THEN 'tautomer' WHEN count(DISTINCT parent_inchikey) = 1 THEN 'salt_form'
      WHEN count(DISTINCT split_part(parent_inchikey, '-', 1)) = 1 THEN 'stereo' ELSE 'different_compound' END AS conflict_type
  FROM found WHERE category IS NULL GROUP BY 1, 2 HAVING count(DISTINCT (canonical_smiles, inchikey)) > 1),
near AS (SELECT id_column, regexp_replace(lower(identifier), '[-_]', '', 'g') AS key, count(DISTINCT identifier) AS identifiers, count(*) AS rows
  FROM found GROUP BY 1, 2 HAVING count(DISTINCT identifier) > 1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MOL.replace("FROM part)", "FROM {part})"), part=table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


def drawn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``mol`` by string rules: sorted characters stand for the skeleton, what follows the first dot for a salt."""
    s = text.strip(F.col("raw_smiles"))
    unclosed = F.length(F.regexp_replace(s, "[^1]", "")) % 2 == 1
    category = text.parse_failure_category(F.col("raw_smiles"), F.when(unclosed, "unclosed ring").otherwise(""))
    key = lambda c: F.concat(F.array_join(F.array_sort(F.split(c, "")), ""), F.lit("-"), F.col(c))
    rows = mol(spark, sf_dir).withColumn("category", category)
    bad = F.col("category") != "other"
    rows = rows.withColumn("canonical_smiles", F.when(~bad, F.replace(F.replace(s, F.lit("[NH3+]"), F.lit("N")), F.lit("[Cl-]"), F.lit("Cl"))))
    rows = rows.withColumn("parent_smiles", F.substring_index("canonical_smiles", ".", 1))
    raw = F.create_map(F.lit("name_id"), F.col("name_id"), F.lit("code_id"), F.col("code_id"))
    dot = F.coalesce(F.col("canonical_smiles").contains("."), F.lit(False))
    return complete(rows.select(
        F.col("row_index").alias("row_seq"), "pool", "source_file", "row_index", "raw_smiles", raw.alias("raw_identifiers"), F.transform_values(raw, lambda _, v: text.normalise_identifier(v)).alias("identifiers"),
        F.when(bad, "string rules").alias("parse_error"), F.when(bad, F.col("category")).alias("parse_error_category"), "canonical_smiles", key("canonical_smiles").alias("inchikey"), "parent_smiles",
        key("parent_smiles").alias("parent_inchikey"), dot.alias("is_mixture"), dot.alias("is_salt_or_solvate"), (~bad & (F.col("raw_smiles") != s)).alias("smiles_whitespace_recovered")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("pool"), F.nullif("text", F.lit("")).alias("text"))


def drawn(check: Callable[[DataFrame], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: (lambda df: df.select(*columns) if columns else df)(check(drawn_records(spark, sf_dir)))


def leak_exact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = documents(spark, sf_dir).where("text is not null").select("pool", F.lit("raw_text").alias("representation"), F.md5("text").alias("value"), F.lit(None).cast("string").alias("inchikey"))
    return checks.reportable(checks.overlap_groups(long, ["representation", "value"])).select("representation", "value", "train_rows", "test_rows")


def leak_rows_by_best_match(records: DataFrame) -> DataFrame:
    return checks.leaked_rows(records).groupBy("pool", "kind").agg(F.count("*").alias("rows"))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of positive components: a bit set for each vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return v.select("vec_id", "label", F.expr("filter(transform(embedding, (x, i) -> if(x > 0, i, -1)), x -> x >= 0)").alias("bits"))


def tanimoto_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = sign_bits(spark, sf_dir)
    left, right = bits.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("a"), "bits"), bits.where("vec_id % 5 = 0").select(F.col("vec_id").alias("b"), "bits")
    return similarity.similar_pairs(left, right, 0.6)


def tanimoto_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both pools with the same set of distinct words: threshold 1 as an equi-join."""
    words = documents(spark, sf_dir).where("text is not null").select("doc_id", "pool", F.sort_array(F.array_distinct(F.split(F.lower("text"), " "))).alias("bits"))
    sets = words.select("doc_id", "pool", F.md5(F.array_join("bits", " ")).alias("bits"))
    return similarity.identical(sets.where("pool = 'train'").select(F.col("doc_id").alias("a"), "bits"), sets.where("pool = 'test'").select(F.col("doc_id").alias("b"), "bits"))


def max_similarity_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.max_similarity(sign_bits(spark, sf_dir), "label").select("label", F.round("max_similarity", 9).alias("max_similarity"))


def conflicts_by_type(records: DataFrame) -> DataFrame:
    return checks.one_id_multiple_structures(records).groupBy("id_column", "conflict_type").agg(F.count("*").alias("identifiers"))


def report_sink(records: DataFrame) -> DataFrame:
    """The whole report written as files and read back through its manifest: findings, rows behind them and pages of these, by section."""
    spark = records.sparkSession
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    sink.write(spark, sink.parts_of(materialise(records), ["name_id", "code_id"], page=100), folder)
    heads, behind, rows = (sink.read(spark, folder, part) for part in ("findings", "occurrences", "rows"))
    none = F.lit(0).cast("long")
    long = (
        heads.select("section", "name", F.lit(1).cast("long").alias("f"), F.col("rows").alias("said"), none.alias("o"), none.alias("p"))
        .union(behind.select("section", "name", none, none, F.size("rows").cast("long"), F.lit(1).cast("long")))
        .union(rows.select("section", "name", F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long"), none)))
    return long.groupBy("section", "name").agg(F.sum("f").alias("findings"), F.sum("said").alias("rows"), F.sum("o").alias("listed"), F.sum("p").alias("pages"))


def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item: candidates share whole words, then containment is checked.

    All but an item's first and last words stand whole in any text that holds it.  Items of five words or more are looked up by words
    two to four, of three or four words by word two; shorter ones, which hold no whole word for sure, by their first four characters
    (or all of them) at every place of a text.
    """
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    words, own = F.split("text", " "), F.split("item", " ")
    three = F.arrays_zip(words.alias("x"), F.slice(words, 2, 1 << 30).alias("y"), F.slice(words, 3, 1 << 30).alias("z"))
    hashed = lambda n, *c: F.xxhash64(F.lit(n), F.concat_ws(" ", *c))
    keyed = items.where("item <> ''").select("item_id", "item", F.size(own).alias("n"), F.length("item").alias("size")).withColumn("kind", F.when(F.col("n") >= 5, 3).when(F.col("n") >= 3, 1).otherwise(-F.least("size", F.lit(4))))
    keyed = keyed.withColumn("gram", F.when(F.col("kind") == 3, hashed(3, F.array_join(F.slice(own, 2, 3), " "))).when(F.col("kind") == 1, hashed(1, F.get(own, F.lit(1)))).otherwise(F.xxhash64("kind", F.substring("item", 1, 4))))
    kinds = [r[0] for r in keyed.select("kind").distinct().collect()]  # at most six
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    grams = {
        3: F.transform(three, lambda x: hashed(3, x["x"], x["y"], x["z"])), 1: F.transform(words, lambda w: hashed(1, w)),
        **{-m: F.transform(places, lambda i, m=m: F.xxhash64(F.lit(-m), F.substr("text", i, F.lit(m)))) for m in range(1, 5)},
    }
    if not kinds:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id")
    found = docs.where("text <> ''").select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[grams[k] for k in kinds])))).alias("gram"))
    pairs = found.join(keyed.select("gram", "item_id", "item"), "gram").select("doc_id", "item_id", "item").distinct()
    return pairs.join(docs, "doc_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "leak_exact_values": leak_exact_values,
    "leak_representations": drawn(checks.exact_overlap, "representation", "value", "train_rows", "test_rows"),
    "leak_rows_by_best_match": drawn(leak_rows_by_best_match),
    "leak_identifier": drawn(checks.identifier_overlap, "id_column", "value", "train_rows", "test_rows"),
    "dup_structure": drawn(checks.duplicate_structures, "pool", "representation", "value", "rows"),
    "dup_identifier": drawn(checks.duplicate_identifiers),
    "id_many_values": drawn(checks.one_id_multiple_structures, "id_column", "identifier", "rows", "structures"),
    "id_conflict_type": drawn(conflicts_by_type),
    "value_many_ids": drawn(checks.one_structure_multiple_ids),
    "id_near_duplicate": drawn(checks.near_duplicate_identifiers),
    "id_whitespace": drawn(checks.identifier_whitespace, "id_column", "row_index", "raw_value", "value"),
    "parse_failure_category": drawn(lambda r: r.where("parse_error is not null").groupBy("parse_error_category").agg(F.count("*").alias("rows"))),
    "broken_rows_by_identifier": drawn(checks.broken_rows_by_identifier),
    "inconsistent_forms": drawn(checks.inconsistent_forms, "inchikey", "forms", "rows"),
    "quality_flags_long": drawn(checks.quality_flags, "category", "row_index"),
    "tanimoto_threshold": tanimoto_threshold,
    "tanimoto_identical": tanimoto_identical,
    "max_similarity_in_group": max_similarity_in_group,
    "benchmark_contamination": benchmark_contamination,
    "report_sink": drawn(report_sink),
}
QUERIES |= molecules.QUERIES | scale.QUERIES

SIGNS = "signs AS (SELECT vec_id, label, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings), bits AS (SELECT vec_id, label, len(bits) AS n, unnest(bits) AS bit FROM signs)"

ORACLE_SQL: dict[str, str] = {
    "leak_exact_values": """SELECT 'raw_text' AS representation, md5(text) AS value, count(*) FILTER (doc_id % 5 <> 0) AS train_rows, count(*) FILTER (doc_id % 5 = 0) AS test_rows FROM documents
        WHERE text <> '' GROUP BY text HAVING count(*) FILTER (doc_id % 5 <> 0) > 0 AND count(*) FILTER (doc_id % 5 = 0) > 0""",
    "leak_representations": SQL + "SELECT * FROM over",
    "leak_rows_by_best_match": SQL + """SELECT pool, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'salt_form' ELSE 'stereo' END AS kind, count(*) AS rows FROM (
        SELECT pool, row_index, min(CASE representation WHEN 'inchikey_connectivity' THEN 2 WHEN 'parent_inchikey' THEN 1 ELSE 0 END) AS r FROM reps JOIN over USING (representation, value) GROUP BY 1, 2) GROUP BY 1, 2""",
    "leak_identifier": SQL + """SELECT id_column, identifier AS value, count(*) FILTER (pool = 'train') AS train_rows, count(*) FILTER (pool = 'test') AS test_rows FROM found GROUP BY 1, 2
        HAVING count(*) FILTER (pool = 'train') > 0 AND count(*) FILTER (pool = 'test') > 0""",
    "dup_structure": SQL + "SELECT * FROM dups",
    "dup_identifier": SQL + "SELECT pool, id_column, identifier AS value, count(*) AS rows FROM found GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "id_many_values": SQL + "SELECT id_column, identifier, rows, structures FROM conflicts",
    "id_conflict_type": SQL + "SELECT id_column, conflict_type, count(*) AS identifiers FROM conflicts GROUP BY 1, 2",
    "value_many_ids": SQL + """SELECT id_column, split_part(parent_inchikey, '-', 1) AS compound_key, count(*) AS rows, count(DISTINCT identifier) AS identifiers,
        CASE WHEN count(DISTINCT (canonical_smiles, inchikey)) = 1 THEN 'same_structure' WHEN count(DISTINCT parent_inchikey) = 1 THEN 'salt_form' ELSE 'stereo' END AS conflict_type,
        arg_min(canonical_smiles, row_index) AS canonical_smiles, arg_min(inchikey, row_index) AS inchikey FROM found WHERE category IS NULL GROUP BY 1, 2 HAVING count(DISTINCT identifier) > 1""",
    "id_near_duplicate": SQL + "SELECT * FROM near",
    "id_whitespace": SQL + f"SELECT id_column, row_index, raw_value, identifier AS value FROM ids WHERE raw_value <> trim(raw_value, {WS})",
    "parse_failure_category": SQL + "SELECT category AS parse_error_category, count(*) AS rows FROM rec WHERE category IS NOT NULL GROUP BY 1",
    "broken_rows_by_identifier": SQL + """SELECT id_column, identifier, count(*) FILTER (category = 'empty') AS missing, count(*) FILTER (category <> 'empty') AS broken, count(*) FILTER (category IS NULL) AS valid,
        count(DISTINCT (canonical_smiles, inchikey)) FILTER (category IS NULL) AS candidates, count(DISTINCT (canonical_smiles, inchikey)) FILTER (category IS NULL) > 1 AS ambiguous FROM found GROUP BY 1, 2
        HAVING count(*) FILTER (category IS NULL) > 0 AND count(*) FILTER (category IS NOT NULL) > 0""",
    "inconsistent_forms": SQL + "SELECT inchikey, count(DISTINCT s) AS forms, count(*) AS rows FROM rec WHERE category IS NULL GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "quality_flags_long": SQL + """SELECT 'smiles_whitespace' AS category, row_index FROM rec WHERE category IS NULL AND raw_smiles <> s UNION ALL SELECT 'mixtures', row_index FROM rec WHERE contains(canonical_smiles, '.')
        UNION ALL SELECT 'salt_or_solvate', row_index FROM rec WHERE contains(canonical_smiles, '.')""",
    "tanimoto_threshold": f"""WITH {SIGNS} SELECT x.vec_id AS a, y.vec_id AS b, count(*) AS common, any_value(x.n) + any_value(y.n) - count(*) AS "union" FROM bits x JOIN bits y USING (bit)
        WHERE x.vec_id % 5 <> 0 AND y.vec_id % 5 = 0 GROUP BY 1, 2 HAVING count(*) >= 0.6 * (any_value(x.n) + any_value(y.n) - count(*))""",
    "tanimoto_identical": """WITH s AS (SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS bits FROM documents WHERE text <> '')
        SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (bits) WHERE x.doc_id % 5 <> 0 AND y.doc_id % 5 = 0""",
    "max_similarity_in_group": f"""WITH {SIGNS}, p AS (SELECT x.label, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM bits x JOIN bits y ON x.label = y.label AND x.bit = y.bit AND x.vec_id < y.vec_id
        GROUP BY x.label, x.vec_id, y.vec_id) SELECT label, round(max(s), 9) AS max_similarity FROM p GROUP BY 1""",
    "benchmark_contamination": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''",
}
# What stands behind each finding, by the value that pages go by: g has a row for each of its rows.
ORACLE_SQL["report_sink"] = SQL + """, linked AS (SELECT *, split_part(parent_inchikey, '-', 1) AS compound, regexp_replace(lower(identifier), '[-_]', '', 'g') AS near_key FROM found),
    shared AS (SELECT id_column, compound FROM linked WHERE category IS NULL GROUP BY 1, 2 HAVING count(DISTINCT identifier) > 1),
    broken AS (SELECT id_column, identifier, count(*) FILTER (category = 'empty') AS missing, count(*) FILTER (category <> 'empty') AS broken FROM found GROUP BY 1, 2
      HAVING count(*) FILTER (category IS NULL) > 0 AND count(*) FILTER (category IS NOT NULL) > 0),
    forms AS (SELECT inchikey FROM rec WHERE category IS NULL GROUP BY 1 HAVING count(DISTINCT s) > 1),
    ids_over AS (SELECT id_column, identifier FROM found GROUP BY 1, 2 HAVING count(*) FILTER (pool = 'train') > 0 AND count(*) FILTER (pool = 'test') > 0),
    ids_twice AS (SELECT pool, id_column, identifier FROM found GROUP BY 1, 2, 3 HAVING count(*) > 1),
    g AS (SELECT 'leak_exact' AS section, representation AS name, NULL AS pool, value, NULL AS part, NULL AS a, inchikey AS b FROM reps JOIN over USING (representation, value)
      UNION ALL SELECT 'leak_identifiers', id_column, NULL, identifier, NULL, canonical_smiles, inchikey FROM found JOIN ids_over USING (id_column, identifier)
      UNION ALL SELECT 'duplicates', representation, pool, value, NULL, NULL, inchikey FROM reps JOIN dups USING (pool, representation, value)
      UNION ALL SELECT 'duplicate_identifiers', id_column, pool, identifier, NULL, canonical_smiles, inchikey FROM found JOIN ids_twice USING (pool, id_column, identifier)
      UNION ALL SELECT 'one_id_multiple_structures', id_column, NULL, identifier, NULL, canonical_smiles, inchikey FROM found JOIN conflicts USING (id_column, identifier) WHERE category IS NULL
      UNION ALL SELECT 'one_structure_multiple_ids', id_column, NULL, compound, identifier, canonical_smiles, inchikey FROM linked JOIN shared USING (id_column, compound) WHERE category IS NULL
      UNION ALL SELECT 'near_duplicates', id_column, NULL, near_key, identifier, canonical_smiles, inchikey FROM linked JOIN (SELECT id_column, key AS near_key FROM near) USING (id_column, near_key)
      UNION ALL SELECT 'id_with_unparseable_and_valid_structures', id_column, NULL, identifier, coalesce(left(category, 0), 'valid'), canonical_smiles, inchikey FROM found JOIN broken USING (id_column, identifier)
        WHERE broken > 0 AND (category IS NULL OR category <> 'empty')
      UNION ALL SELECT 'missing_structure_resolvable_by_id', id_column, NULL, identifier, coalesce(category, 'valid'), canonical_smiles, inchikey FROM found JOIN broken USING (id_column, identifier)
        WHERE missing > 0 AND (category IS NULL OR category = 'empty')
      UNION ALL SELECT 'inconsistent_smiles', NULL, NULL, inchikey, s, canonical_smiles, inchikey FROM rec JOIN forms USING (inchikey) WHERE category IS NULL),
    lists AS (SELECT section, name, pool, value, count(*) AS n FROM g GROUP BY ALL),
    cut AS (SELECT section, name, count(*) AS n, (count(*) + 99) // 100 AS pages FROM g GROUP BY section, name, pool, value, part, a, b),
    one AS (SELECT 'unparseable_smiles' AS section, category AS name FROM rec WHERE category IS NOT NULL UNION ALL SELECT 'identifier_whitespace', id_column FROM ids WHERE raw_value <> identifier OR (identifier IS NULL AND raw_value <> '')
      UNION ALL SELECT 'quality_flags', 'smiles_whitespace' FROM rec WHERE category IS NULL AND raw_smiles <> s
      UNION ALL SELECT 'quality_flags', unnest(['mixtures', 'salt_or_solvate']) FROM rec WHERE contains(canonical_smiles, '.'))
  SELECT x.section, x.name, x.findings, x.rows, y.listed, y.pages FROM (SELECT section, name, count(*) AS findings, sum(n)::BIGINT AS rows FROM lists GROUP BY 1, 2) x
    JOIN (SELECT section, name, sum(n)::BIGINT AS listed, sum(pages)::BIGINT AS pages FROM cut GROUP BY 1, 2) y ON x.section = y.section AND x.name IS NOT DISTINCT FROM y.name
  UNION ALL SELECT section, name, count(*), count(*), count(*), 0 FROM one GROUP BY 1, 2"""
ORACLE_SQL |= molecules.ORACLE_SQL | scale.ORACLE_SQL
