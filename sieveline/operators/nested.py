"""Findings with the rows behind them as nested columns, one row per finding, in the shape that reports have.

Lists are as long as a finding is large, so these tables are for reports; counts and tiers come from the flat checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import checks, nearest, similarity
from .records import identifier_rows, in_order, is_parsed, location, representations

BY_ID = ["id_column", "identifier"]


def ids_of(records: DataFrame) -> DataFrame:
    return identifier_rows(records).where("identifier is not null")


def gathered(rows: DataFrame, keys: list[str], name: str = "occurrences", loc: Column | None = None) -> DataFrame:
    return rows.groupBy(*keys).agg(in_order(F.collect_list(location() if loc is None else loc)).alias(name))


def listed(parts: DataFrame, keys: list[str], fields: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows of a key as a sorted list of structs of some fields."""
    sorted_list = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))))
    return parts.groupBy(*keys).agg(F.transform(sorted_list, lambda x: x["v"]).alias(name))


def structures(rows: DataFrame, keys: list[str], name: str = "structures") -> DataFrame:
    """The distinct structures behind each key, with the rows where they appear."""
    what = ["canonical_smiles", "inchikey"]
    order = [F.coalesce(F.col(c), F.lit("")).alias(f"o_{c}") for c in what]
    return listed(gathered(rows, [*keys, *what]), keys, [*what, "occurrences"], order, name)


def identifiers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The identifiers behind each key, with the rows where they appear."""
    return listed(gathered(rows, [*keys, "identifier"]), keys, ["identifier", "occurrences"], [F.col("identifier").alias("o_id")], "identifiers")


def best_similarity(rows: DataFrame) -> DataFrame:
    """The largest Tanimoto similarity of two structures of an identifier; none where fewer than two have fingerprints."""
    first = rows.where("fp is not null").groupBy(*BY_ID, "canonical_smiles", "inchikey").agg(F.min_by("fp", "row_seq").alias("fp"))
    group = F.to_json(F.struct(*BY_ID)).alias("group")
    sets = first.select(*BY_ID, group, similarity.bits_of(F.col("fp")).alias("bits"))
    found = nearest.max_similarity(sets.select("group", "bits"), "group")
    return sets.select("group", *BY_ID).distinct().join(found, "group").select(*BY_ID, "max_similarity")


def one_id_multiple_structures(records: DataFrame, strip_salts: bool = True) -> DataFrame:
    """id_column, identifier, conflict_type, max_similarity, structures."""
    ids = ids_of(records)
    groups = checks.conflicting_identifiers(ids, strip_salts).select(*BY_ID, "conflict_type")
    rows = ids.where(is_parsed()).join(groups.select(*BY_ID), BY_ID, "left_semi")
    return groups.join(best_similarity(rows), BY_ID, "left").join(structures(rows, BY_ID), BY_ID)


def one_structure_multiple_ids(records: DataFrame, strip_salts: bool = True) -> DataFrame:
    """id_column, compound_key, conflict_type, canonical_smiles, inchikey, identifiers."""
    ids, keys = ids_of(records), ["id_column", "compound_key"]
    groups = checks.shared_compounds(ids, strip_salts).select(*keys, "conflict_type", "canonical_smiles", "inchikey")
    rows = ids.where(is_parsed()).withColumn("compound_key", checks.compound_key(strip_salts)).join(groups.select(*keys), keys, "left_semi")
    return groups.join(identifiers(rows, keys), keys)


def near_duplicates(records: DataFrame, unicode: bool = True) -> DataFrame:
    """id_column, key, identifiers."""
    rows = ids_of(records).withColumn("key", text.near_duplicate_key(F.col("identifier"), unicode))
    return identifiers(rows, ["id_column", "key"]).where(F.size("identifiers") > 1)


def unparseable_and_valid(records: DataFrame) -> DataFrame:
    """id_column, identifier, structures, unparseable (with error and category)."""
    ids = ids_of(records)
    groups = checks.broken_identifiers(ids).where("broken > 0").select(*BY_ID)
    rows = ids.join(groups, BY_ID, "left_semi")
    bad = rows.where(~is_parsed() & ~F.col("parse_error_category").eqNullSafe("empty"))
    fields = ["pool", "source_file", "row_index", "raw_smiles", F.col("parse_error").alias("error"), F.coalesce("parse_error_category", F.lit("other")).alias("category")]
    return structures(rows.where(is_parsed()), BY_ID).join(listed(bad, BY_ID, fields, [F.col("row_seq").alias("o_seq")], "unparseable"), BY_ID)


def missing_resolvable(records: DataFrame) -> DataFrame:
    """id_column, identifier, missing, candidates, ambiguous."""
    ids = ids_of(records)
    groups = checks.broken_identifiers(ids).where("missing > 0").select(*BY_ID, "ambiguous")
    rows = ids.join(groups.select(*BY_ID), BY_ID, "left_semi")
    empty = rows.where(~is_parsed() & (F.col("parse_error_category") == "empty"))
    return gathered(empty, BY_ID, "missing").join(structures(rows.where(is_parsed()), BY_ID, "candidates"), BY_ID).join(groups, BY_ID)


def inconsistent(records: DataFrame) -> DataFrame:
    """canonical_smiles, inchikey, representations (raw_smiles, source_files, occurrences)."""
    groups = checks.inconsistent_forms(records).select("inchikey", "canonical_smiles")
    rows = records.where(is_parsed()).join(groups.select("inchikey"), "inchikey", "left_semi").withColumn("form", text.strip(F.col("raw_smiles")))
    parts = rows.groupBy("inchikey", "form").agg(in_order(F.collect_list(location())).alias("occurrences"), F.array_sort(F.collect_set("source_file")).alias("source_files"))
    return groups.join(listed(parts, ["inchikey"], [F.col("form").alias("raw_smiles"), "source_files", "occurrences"], [F.col("form").alias("o_form")], "representations"), "inchikey")


def overlaps(records: DataFrame) -> DataFrame:
    """representation, value, train_occurrences, test_occurrences."""
    long = representations(records)
    return sides(long.join(checks.overlapping(long).select("representation", "value"), ["representation", "value"], "left_semi"), ["representation", "value"], F.col("loc"))


def identifier_overlaps(records: DataFrame) -> DataFrame:
    """id_column, value, train_occurrences, test_occurrences."""
    ids = ids_of(records)
    shared = ids.join(checks.overlap_groups(ids, BY_ID).select(*BY_ID), BY_ID, "left_semi").withColumnRenamed("identifier", "value")
    return sides(shared, ["id_column", "value"], location())


def sides(rows: DataFrame, keys: list[str], loc: Column) -> DataFrame:
    side = lambda pool: in_order(F.collect_list(F.when(F.col("pool") == pool, loc))).alias(f"{pool}_occurrences")
    return rows.groupBy(*keys).agg(side("train"), side("test"))


def duplicates(records: DataFrame) -> DataFrame:
    """pool, representation, value, occurrences."""
    long, keys = representations(records), ["pool", "representation", "value"]
    return gathered(long.join(checks.repeated(long).select(*keys), keys, "left_semi"), keys, loc=F.col("loc"))


def identifier_duplicates(records: DataFrame) -> DataFrame:
    """pool, id_column, value, occurrences."""
    ids, keys = ids_of(records), ["pool", *BY_ID]
    rows = ids.join(checks.repeated_identifiers(ids).select(*keys), keys, "left_semi")
    return gathered(rows, keys).withColumnRenamed("identifier", "value")
