"""From raw structure strings to records: one vectorised pass over distinct strings and native columns made of it, joined to the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..functions import values as V
from ..operators.records import complete, identifier_rows
from ..sources.shared import materialise
from . import molecule as M

KERNEL = (
    "raw_smiles string, message string, warning string, recovered boolean, canonical_smiles string, inchikey string, fp_bits array<int>, heavy int, parts int, charge int, metal boolean, "
    "centres int, stereo_bonds int, has_carbon boolean, fragments array<struct<smiles:string,key:string,heavy:int,mass:double,inchikey:string,metal_atom:boolean>>"
)


@dataclass(frozen=True)
class Settings:
    strip_salts: bool = True
    case_insensitive_identifiers: bool = False
    multi_component_min_heavy_atoms: int = 6
    max_train_test_similarity: float = 1.0
    fingerprint_radius: int = 2
    fingerprint_bits: int = 2048
    tautomer_standardisation: bool = False


def describe(raw: str, radius: int, bits: int, tautomers: bool = False) -> dict:
    """What the kernel says of one string; ``message`` is the reason if it cannot be read."""
    out = {"raw_smiles": raw, "recovered": False}
    white = "".join(V.WHITE_SPACE)
    try:
        try:
            mol = M.parse(raw.rstrip(white) if raw[:1] not in white else raw)
        except M.SmilesError:
            if raw.strip(white) == raw:
                raise
            mol = M.parse(raw.strip(white))
            out["recovered"] = "|" in raw
        if tautomers:
            warning, mol = mol.warning, M.canonical_tautomer(mol)
            mol.warning = warning
        fragments = []
        for atoms in mol.fragments():
            part = mol.part(atoms)
            M.perceive(part)
            neutral = M.neutralised(part)
            fragments.append({
                "smiles": M.write(part), "key": M.write(neutral, stereo=False), "heavy": M.heavy(part), "mass": M.mass(part), "inchikey": M.structure_key(neutral),
                "metal_atom": len(part.atoms) == 1 and part.atoms[0].symbol in V.METALS})
        centres, bonds = M.undefined_stereo(mol)
        key = M.structure_key(mol)
        out |= {
            "warning": mol.warning, "canonical_smiles": M.write(mol), "inchikey": key, "fp_bits": M.fingerprint(mol, radius, bits), "heavy": M.heavy(mol), "parts": len(fragments),
            "charge": sum(a.charge for a in mol.atoms), "metal": any(a.symbol in V.METALS for a in mol.atoms), "centres": centres, "stereo_bonds": bonds,
            "has_carbon": any(a.symbol == "C" for a in mol.atoms), "fragments": fragments}
    except M.SmilesError as e:
        out["message"] = str(e)
    except Exception as e:  # a row never fails the job
        out["message"] = f"Processing failed: {type(e).__name__}: {e}"
    return out


def fragment_keys(smiles: list[str]) -> list[str]:
    return sorted({M.write(M.neutralised(M.parse(s)), stereo=False) for s in smiles})


def kernel(strings: DataFrame, radius: int, bits: int, tautomers: bool = False) -> DataFrame:
    """raw_smiles and readable: what the kernel says of each string that is readable, and nulls for the others."""
    arrow = to_arrow_schema(strings.sparkSession.createDataFrame([], KERNEL).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_pylist([describe(s, radius, bits, tautomers) if readable else {"raw_smiles": s} for s, readable in asked], schema=arrow)

    return strings.select("raw_smiles", "readable").mapInArrow(run, KERNEL)


def tasks(df: DataFrame) -> int:
    """Among how many tasks costly work on small rows is dealt, which sizes in bytes would leave to one or two."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def structures(strings: DataFrame, settings: Settings) -> DataFrame:
    """raw_smiles, distinct -> all record columns that follow from the string."""
    blank, control = text.strip(F.col("raw_smiles")) == "", text.has_embedded_control_characters(F.col("raw_smiles"))
    rows = kernel(strings.withColumn("readable", ~blank & ~control), settings.fingerprint_radius, settings.fingerprint_bits, settings.tautomer_standardisation)
    counterions, solvents, small = (fragment_keys(x) for x in (V.COUNTERIONS, V.SOLVENTS, V.SMALL_MOLECULES))
    kind = lambda f: F.when(f["metal_atom"] | f["key"].isin(counterions), "counterion").when(f["key"].isin(solvents), "solvent").otherwise("unknown")
    rows = rows.withColumn("fragments", F.transform("fragments", lambda f: F.struct(f["heavy"].alias("heavy"), f["mass"].alias("mass"), f["smiles"].alias("smiles"), f["key"].alias("key"), f["inchikey"].alias("inchikey"), kind(f).alias("kind"))))
    unknown = F.filter("fragments", lambda f: f["kind"] == "unknown")
    rows = rows.withColumn("parent", F.array_max(F.when(F.size(unknown) > 0, unknown).otherwise(F.col("fragments"))))
    known_parent = F.col("parent.kind") == "unknown"
    same = lambda f: known_parent & (f["smiles"] == F.col("parent.smiles"))
    # The parent is one of its equals; the others of these are copies.
    others = F.transform(F.filter("fragments", lambda f: ~same(f) & (f != F.col("parent"))), lambda f: F.struct(f["smiles"].alias("smiles"), f["kind"].alias("kind"), f["heavy"].alias("heavy")))
    copies = F.transform(F.filter("fragments", lambda f: f == F.col("parent")), lambda f: F.struct(f["smiles"].alias("smiles"), F.when(known_parent, "parent_copy").otherwise(f["kind"]).alias("kind"), f["heavy"].alias("heavy")))
    rows = rows.withColumn("others", F.concat(others, F.slice(copies, 2, 1 << 30)))
    no = F.lit(False)
    salt = F.coalesce(known_parent & F.forall("others", lambda f: f["kind"] != "unknown") & F.exists("others", lambda f: f["kind"].isin("counterion", "solvent")), no)
    dimer = F.coalesce((F.size("others") > 0) & F.forall("others", lambda f: f["kind"] == "parent_copy"), no)
    large = F.filter("fragments", lambda f: (f["kind"] == "unknown") & (f["heavy"] >= settings.multi_component_min_heavy_atoms))
    multi = F.coalesce(F.size(F.array_distinct(F.transform(large, lambda f: f["smiles"]))) >= 2, no)
    error = F.when(blank, "Empty or non-string SMILES value").when(control, "SMILES contains control characters").otherwise(F.col("message"))
    category = F.when(F.col("message").startswith("Processing failed"), "processing").otherwise(text.parse_failure_category(F.col("raw_smiles"), F.col("message")))
    bits = F.col("fp_bits")
    words = F.transform(F.sequence(F.lit(0), F.lit((settings.fingerprint_bits + 63) // 64 - 1)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int")))))
    whole = F.size("others") == 0
    return rows.select(
        "raw_smiles", error.alias("parse_error"), F.when(error.isNotNull(), category).alias("parse_error_category"),
        F.col("warning").alias("rdkit_warning"), F.coalesce("recovered", no).alias("smiles_whitespace_recovered"), "canonical_smiles", "inchikey", F.when(bits.isNotNull(), words).alias("fp"), F.size(bits).alias("fp_n"),
        F.when(whole, F.col("canonical_smiles")).otherwise(F.col("parent.key")).alias("parent_smiles"), F.when(whole, F.col("parent.inchikey")).otherwise(F.col("parent.inchikey")).alias("parent_inchikey"),
        F.transform("others", lambda f: F.struct(f["smiles"].alias("smiles"), f["kind"].alias("kind"))).alias("stripped_fragments"), F.col("heavy").alias("heavy_atom_count"), F.col("parts").alias("num_fragments"),
        F.col("charge").alias("net_charge"), (error.isNull() & F.col("raw_smiles").contains(".")).alias("has_dot"), F.coalesce("metal", no).alias("contains_metal"),
        F.coalesce(error.isNull() & (F.col("raw_smiles").contains(".") | (F.col("parts") > 1)), no).alias("is_mixture"), (F.coalesce("metal", no) | salt).alias("is_salt_or_metal"), salt.alias("is_salt_or_solvate"),
        multi.alias("is_multi_component"), dimer.alias("is_homodimer_without_counterion"), F.coalesce((F.size("others") > 0) & ~salt & ~dimer & ~multi, no).alias("is_unclassified_mixture"),
        F.coalesce("centres", F.lit(0)).alias("undefined_stereocentres"), F.coalesce("stereo_bonds", F.lit(0)).alias("undefined_stereo_bonds"),
        F.coalesce((F.col("heavy") <= 3) & ~F.col("parent.key").isin(small) & (F.col("has_carbon") | (F.col("heavy") <= 1)), no).alias("is_suspicious_fragment"))


def enrich(pool: DataFrame, settings: Settings | None = None) -> DataFrame:
    """pool (row_seq, pool, source_file, row_index, raw_smiles, raw_identifiers) -> the record table.

    Equal strings are read once, and all that follows from a string is made once, in a table of its own whose size the join knows.
    """
    settings = settings or Settings()
    raw = pool.select("row_seq", "pool", "source_file", "row_index", F.coalesce("raw_smiles", F.lit("")).alias("raw_smiles"), "raw_identifiers")
    said = materialise(structures(raw.select("raw_smiles").distinct().repartition(tasks(pool), "raw_smiles"), settings))
    ids = F.transform_values("raw_identifiers", lambda _, v: text.normalise_identifier(v, settings.case_insensitive_identifiers))
    return complete(raw.repartition(tasks(pool), "row_seq").withColumn("identifiers", ids).join(said, "raw_smiles", "left"))


def tautomer_key(smiles: str | None) -> str | None:
    """The skeleton block of a structure's preferred tautomer."""
    try:
        return M.structure_key(M.canonical_tautomer(M.parse(smiles))).split("-")[0] if smiles else None
    except Exception:  # a structure that the search fails on has no key
        return None


def with_tautomer_keys(records: DataFrame, strip_salts: bool = True) -> DataFrame:
    """Fills tautomer_key, for the structures of conflicting identifiers only, since the search for tautomers is costly."""
    smiles = F.coalesce("parent_smiles", "canonical_smiles") if strip_salts else F.col("canonical_smiles")
    ids = identifier_rows(records).where("identifier is not null and parse_error is null").withColumn("drawn", smiles)
    ids = ids.select("id_column", "identifier", "canonical_smiles", "inchikey", "drawn").distinct()
    several = ids.groupBy("id_column", "identifier").agg(F.count_distinct("canonical_smiles", "inchikey").alias("n")).where("n > 1")
    asked = ids.join(several.select("id_column", "identifier"), ["id_column", "identifier"], "left_semi").select("drawn").distinct().repartition(tasks(records), "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(tautomer_key, batch.column(0).to_pylist()), pa.string())], ["drawn", "key"])

    found = materialise(asked.mapInArrow(run, "drawn string, key string"))
    rows = records.drop("tautomer_key").withColumn("drawn", smiles).join(found, "drawn", "left").withColumnRenamed("key", "tautomer_key")
    return rows.select(*records.columns)
