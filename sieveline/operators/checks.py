"""Leakage, duplicate, identifier, consistency, parse and quality checks: each a function of the record table.

Every check is one grouped aggregation (or a semi-join of two); counts come from partial sums, and lists of occurrences
come in pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as V
from ..sources.shared import materialise
from . import pages
from .records import coarse, distinct_with_null, identifier_rows, is_parsed, representations


# Leakage


def overlap_groups(long: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a long table that both pools have: train_rows, test_rows and the number of structures behind them."""
    sums = long.groupBy(*keys).agg(F.count_if(F.col("pool") == "train").alias("train_rows"), F.count_if(F.col("pool") == "test").alias("test_rows"), distinct_with_null("inchikey").alias("structures"))
    return sums.where("train_rows > 0 and test_rows > 0")


def reportable(groups: DataFrame) -> DataFrame:
    """Groups under a coarse key count only if they join more than one structure (a null structure is one)."""
    return groups.where(~coarse(F.col("representation")) | (F.col("structures") > 1))


def overlapping(long: DataFrame) -> DataFrame:
    return reportable(overlap_groups(long, ["representation", "value"]))


def exact_overlap(records: DataFrame) -> DataFrame:
    return overlapping(representations(records))


def identifier_overlap(records: DataFrame) -> DataFrame:
    rows = identifier_rows(records).where("identifier is not null").withColumnRenamed("identifier", "value")
    return overlap_groups(rows, ["id_column", "value"])


def occurrence_pages(groups: DataFrame, long: DataFrame, keys: list[str], size: int = pages.PAGE) -> DataFrame:
    """Groups with the locations of their rows in input order, ``size`` to a page at most; long has a column loc."""
    rows = long.join(groups.select(*keys), keys, "left_semi").select(*keys, "loc", F.col("loc.row_seq").alias("__seq"))
    place = F.struct("loc.pool", "loc.source_file", "loc.row_index", "loc.raw_smiles")
    return groups.join(pages.paged(rows, keys, "__seq", place, size, "occurrences"), keys)


def leaked_rows(records: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """Each row that overlaps, by its strongest kind: exact, then salt_form, then stereo."""
    long = representations(records)
    overlaps = exact_overlap(records) if overlaps is None else overlaps
    rank = F.when(F.col("representation").isin(V.STEREO_INSENSITIVE), 2).when(F.col("representation").isin(V.SALT_INSENSITIVE), 1).otherwise(0)
    overlaps = materialise(overlaps.select("representation", "value"))  # of known size, so that few of them do not shuffle all rows
    hit = long.join(overlaps, ["representation", "value"], "left_semi")
    best = hit.groupBy("loc.pool", "loc.source_file", "loc.row_index").agg(F.min(rank).alias("rank"))
    return best.withColumn("kind", F.element_at(F.array(F.lit("exact"), F.lit("salt_form"), F.lit("stereo")), F.col("rank") + 1))


# Duplicates


def repeated(long: DataFrame) -> DataFrame:
    groups = long.groupBy("pool", "representation", "value").agg(F.count("*").alias("rows"), distinct_with_null("inchikey").alias("structures"))
    return reportable(groups.where("rows > 1"))


def duplicate_structures(records: DataFrame) -> DataFrame:
    return repeated(representations(records))


def repeated_identifiers(ids: DataFrame) -> DataFrame:
    return ids.groupBy("pool", "id_column", "identifier").agg(F.count("*").alias("rows")).where("rows > 1")


def duplicate_identifiers(records: DataFrame) -> DataFrame:
    return repeated_identifiers(identifier_rows(records).where("identifier is not null")).withColumnRenamed("identifier", "value")


# Identifier namespace


def compound_key(strip_salts: bool = True) -> Column:
    return text.connectivity(F.coalesce("parent_inchikey", "inchikey") if strip_salts else F.col("inchikey"))


def all_equal(c: Column | str) -> Column:
    """One distinct value, and null nowhere; by least and greatest, since every further count of distinct values copies all rows."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))


def one_id_multiple_structures(records: DataFrame, strip_salts: bool = True) -> DataFrame:
    return conflicting_identifiers(identifier_rows(records).where("identifier is not null"), strip_salts)


def conflicting_identifiers(ids: DataFrame, strip_salts: bool = True) -> DataFrame:
    """Identifiers with several structures among parsed rows, and what tells these apart."""
    rows = ids.where(is_parsed()).withColumn("compound_key", compound_key(strip_salts))
    kind = (
        F.when(all_equal("inchikey"), "tautomer")
        .when(F.lit(strip_salts) & all_equal("parent_inchikey"), "salt_form")
        .when(all_equal("compound_key"), "stereo")
        .when(all_equal("tautomer_key"), "tautomer")
        .otherwise("different_compound")
    )
    groups = rows.groupBy("id_column", "identifier").agg(F.count("*").alias("rows"), distinct_with_null("canonical_smiles", "inchikey").alias("structures"), kind.alias("conflict_type"))
    return groups.where("structures > 1")


def one_structure_multiple_ids(records: DataFrame, strip_salts: bool = True) -> DataFrame:
    return shared_compounds(identifier_rows(records).where("identifier is not null"), strip_salts)


def shared_compounds(ids: DataFrame, strip_salts: bool = True) -> DataFrame:
    """Compounds under several identifiers; named by their first row in input order."""
    rows = ids.where(is_parsed()).withColumn("compound_key", compound_key(strip_salts)).where("compound_key is not null")
    structure = F.struct("canonical_smiles", "inchikey")
    one = F.min(structure) == F.max(structure)  # nulls within are equal
    kind = F.when(one, "same_structure").when(F.lit(strip_salts) & all_equal("parent_inchikey"), "salt_form").otherwise("stereo")
    first = F.min(F.struct("row_seq", "canonical_smiles", "inchikey"))
    groups = rows.groupBy("id_column", "compound_key").agg(F.count("*").alias("rows"), F.count_distinct("identifier").alias("identifiers"), kind.alias("conflict_type"), first.alias("first"))
    return groups.where("identifiers > 1").select("id_column", "compound_key", "rows", "identifiers", "conflict_type", "first.canonical_smiles", "first.inchikey")


def identifier_whitespace(records: DataFrame) -> DataFrame:
    rows = identifier_rows(records)
    return rows.where(F.col("raw_value") != text.strip(F.col("raw_value"))).select("id_column", "pool", "source_file", "row_index", "raw_smiles", "raw_value", F.col("identifier").alias("value"))


def near_duplicate_identifiers(records: DataFrame, unicode: bool = True) -> DataFrame:
    rows = identifier_rows(records).where("identifier is not null").withColumn("key", text.near_duplicate_key(F.col("identifier"), unicode))
    return rows.groupBy("id_column", "key").agg(F.count_distinct("identifier").alias("identifiers"), F.count("*").alias("rows")).where("identifiers > 1")


def broken_rows_by_identifier(records: DataFrame) -> DataFrame:
    return broken_identifiers(identifier_rows(records).where("identifier is not null"))


def broken_identifiers(rows: DataFrame) -> DataFrame:
    """Identifiers that unparsed and parsed rows share: how many rows lack a structure or have a broken one, and the candidates."""
    missing = ~is_parsed() & (F.col("parse_error_category") == "empty")
    groups = rows.groupBy("id_column", "identifier").agg(
        F.count_if(missing).alias("missing"), F.count_if(~is_parsed() & ~missing).alias("broken"),
        F.count_if(is_parsed()).alias("valid"), F.count_distinct(F.when(is_parsed(), F.struct("canonical_smiles", "inchikey"))).alias("candidates"))
    return groups.where("valid > 0 and missing + broken > 0").withColumn("ambiguous", F.col("candidates") > 1)


# Consistency, parsing, quality


def inconsistent_forms(records: DataFrame) -> DataFrame:
    """Structures that are written in several ways."""
    rows = records.where(is_parsed() & F.col("inchikey").isNotNull()).withColumn("form", text.strip(F.col("raw_smiles")))
    groups = rows.groupBy("inchikey").agg(F.count_distinct("form").alias("forms"), F.count("*").alias("rows"), F.min(F.struct("row_seq", "canonical_smiles")).alias("first"))
    return groups.where("forms > 1").select("inchikey", "forms", "rows", "first.canonical_smiles")


def unparseable(records: DataFrame, id_columns: list[str]) -> DataFrame:
    """Unparsed rows with their category; for empty ones, the first identifier column that leads to exactly one structure."""
    where = ["row_seq", "pool", "source_file", "row_index", "raw_smiles", "parse_error"]
    bad = records.where(~is_parsed()).select(*where, F.coalesce("parse_error_category", F.lit("other")).alias("category"))
    if not id_columns:
        return bad.withColumn("resolvable_via_identifier", F.lit(None).cast("string"))
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(id_columns) for x in (c, i)])
    rows = identifier_rows(records).where("identifier is not null")
    one = broken_identifiers(rows).where("missing > 0 and not ambiguous").select("id_column", "identifier")
    empty = rows.where(~is_parsed() & (F.col("parse_error_category") == "empty"))
    best = empty.join(one, ["id_column", "identifier"], "left_semi").groupBy("row_seq").agg(F.min_by("id_column", rank[F.col("id_column")]).alias("resolvable_via_identifier"))
    return bad.join(best, "row_seq", "left")


def quality_flags(records: DataFrame) -> DataFrame:
    """Long form of all quality categories in one scan: category and row, with charge, stereo counts or warning."""
    stereo = (F.col("undefined_stereocentres") > 0) | (F.col("undefined_stereo_bonds") > 0)
    tests = {
        "salt_or_solvate": F.col("is_salt_or_solvate"), "contains_metal": F.col("contains_metal"), "multi_component": F.col("is_multi_component"),
        "homodimer_without_counterion": F.col("is_homodimer_without_counterion"), "unclassified_mixture": F.col("is_unclassified_mixture"), "net_charge": F.coalesce("net_charge", F.lit(0)) != 0,
        "undefined_stereo": stereo, "suspicious_fragments": F.col("is_suspicious_fragment"), "smiles_whitespace": F.col("smiles_whitespace_recovered"), "rdkit_warnings": F.col("rdkit_warning").isNotNull(),
        "mixtures": F.col("is_mixture"), "salts_or_metal_complexes": F.col("is_salt_or_metal"),
    }
    hits = F.array_compact(F.array(*[F.when(tests[q], F.lit(q)) for q in V.QUALITY_FLAGS]))
    return records.select(
        F.explode(hits).alias("category"), "row_seq", "pool", "source_file", "row_index", "raw_smiles", F.col("net_charge").alias("charge"),
        F.col("undefined_stereocentres").alias("stereocentres"), F.col("undefined_stereo_bonds").alias("stereo_bonds"), F.col("rdkit_warning").alias("warning"))
