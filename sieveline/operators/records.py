"""The record table that all checks read, and its long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions import values as V

#: Columns a record table has, with their types and what an unparsed row holds.
SCHEMA = {
    "row_seq": ("bigint", None), "pool": ("string", None), "source_file": ("string", None), "row_index": ("bigint", None), "raw_smiles": ("string", ""),
    "identifiers": ("map<string,string>", None), "raw_identifiers": ("map<string,string>", None), "parse_error": ("string", None), "parse_error_category": ("string", None), "rdkit_warning": ("string", None),
    "smiles_whitespace_recovered": ("boolean", False), "canonical_smiles": ("string", None), "inchikey": ("string", None), "fp": ("array<bigint>", None), "fp_n": ("int", None),
    "parent_smiles": ("string", None), "parent_inchikey": ("string", None), "tautomer_key": ("string", None), "stripped_fragments": ("array<struct<smiles:string,kind:string>>", None),
    "heavy_atom_count": ("int", None), "num_fragments": ("int", None), "net_charge": ("int", None), "has_dot": ("boolean", False), "contains_metal": ("boolean", False), "is_mixture": ("boolean", False),
    "is_salt_or_metal": ("boolean", False), "is_salt_or_solvate": ("boolean", False), "is_multi_component": ("boolean", False), "is_homodimer_without_counterion": ("boolean", False),
    "is_unclassified_mixture": ("boolean", False), "undefined_stereocentres": ("int", 0), "undefined_stereo_bonds": ("int", 0), "is_suspicious_fragment": ("boolean", False),
}


def complete(df: DataFrame) -> DataFrame:
    """Adds the record columns that are missing, with the value of an unparsed row."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in SCHEMA.items()])


def location() -> Column:
    return F.struct("row_seq", "pool", "source_file", "row_index", "raw_smiles")


def row_key() -> Column:
    """A row's identity in findings; the same path listed twice gives equal keys."""
    return F.struct("pool", "source_file", "row_index")


def is_parsed() -> Column:
    return F.col("parse_error").isNull()


def in_order(locations: Column) -> Column:
    """Collected locations in input order, without the sequence number."""
    return F.transform(F.array_sort(locations), lambda x: F.struct(x["pool"].alias("pool"), x["source_file"].alias("source_file"), x["row_index"].alias("row_index"), x["raw_smiles"].alias("raw_smiles")))


def representations(records: DataFrame) -> DataFrame:
    """Long form: one row per record and non-null representation; one scan and one explode for all five."""
    keys = {
        "raw_smiles": F.nullif("raw_smiles", F.lit("")), "canonical_smiles": F.col("canonical_smiles"), "inchikey": F.col("inchikey"),
        "parent_inchikey": F.col("parent_inchikey"), "inchikey_connectivity": text.connectivity(F.col("inchikey")),
    }
    pairs = F.array(*[F.struct(F.lit(r).alias("representation"), keys[r].alias("value")) for r in V.REPRESENTATIONS])
    return records.select(location().alias("loc"), "pool", "inchikey", F.explode(pairs).alias("k")).select("loc", "pool", "inchikey", "k.representation", "k.value").where("value is not null")


def identifier_rows(records: DataFrame) -> DataFrame:
    """Long form: one row per record and identifier column, with value and raw value (either may be null)."""
    long = records.select("*", F.explode("raw_identifiers").alias("id_column", "raw_value"))
    return long.withColumn("identifier", F.col("identifiers")[F.col("id_column")])


def coarse(representation: Column) -> Column:
    return representation.isin(V.SALT_INSENSITIVE + V.STEREO_INSENSITIVE)


def distinct_with_null(*columns: str) -> Column:
    """count(distinct) that counts null as a value."""
    return F.count_distinct(F.struct(*columns))
