"""Reports of any size as files in a folder: tasks write the findings, a manifest that is committed last names what is valid.

A report has three parts, each partitioned by section, and similar pairs as a fourth:

    findings     a row for each finding of several rows: what they share, how many they are, and what kind of finding it is
    occurrences  the rows behind a finding, in pages, so that no list grows with a hot value
    rows         findings of one row each: unparsed rows, quality flags, identifiers with white space

All rows behind findings are one relation, so pages take one range shuffle whatever the number of checks.  The driver holds the
manifest alone: the summary's numbers, and for each part its rows, files, bytes and schema.

A run writes to a folder of its own.  The manifest replaces the one before in one rename; until then readers see the earlier report,
and what an interrupted run has left is removed by the next run that is committed.  Null values are kept apart from empty ones.  A
report without findings has parts without rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import checks, nested, pages
from ..operators.records import identifier_rows, is_parsed, representations
from ..sources.shared import materialise

FORMATS = {"jsonl": "json", "parquet": "parquet"}
KEY = ["section", "pool", "name", "value"]
HEAD = {"rows": "long", "kind": "string", "canonical_smiles": "string", "inchikey": "string", "ambiguous": "boolean", "max_similarity": "double"}
WITHIN = ["part", "canonical_smiles", "inchikey"]
MANIFEST = "manifest.json"


class SinkError(ValueError):
    """A folder that holds no committed report."""


def place(loc: str = "", error: Column | None = None, category: Column | None = None) -> Column:
    at = lambda c: F.col(f"{loc}{c}").alias(c)
    none = F.lit(None).cast("string")
    return F.struct(at("pool"), at("source_file"), at("row_index"), at("raw_smiles"), (none if error is None else error).alias("error"), (none if category is None else category).alias("category"))


def finding(section: str, groups: DataFrame, source: DataFrame, keys: list[str], name: str | None, value: str, pool: str | None = None, part: Column | None = None, **head: Column | str) -> tuple[DataFrame, DataFrame]:
    """Groups as findings, and the rows of ``source`` (with seq, loc, canonical_smiles, inchikey) that have the keys of one."""
    named = [F.lit(section).alias("section"), *[(F.lit(None).cast("string") if c is None else F.col(c)).alias(n) for n, c in (("pool", pool), ("name", name), ("value", value))]]
    said = {c: F.col(x) if isinstance(x, str) else x for c, x in head.items()}
    heads = groups.select(*named, *[said.get(c, F.lit(None)).cast(t).alias(c) for c, t in HEAD.items()])
    rows = source.join(groups.select(*keys), keys, "left_semi")
    return heads, rows.select(*named, (F.lit(None).cast("string") if part is None else part).alias("part"), "canonical_smiles", "inchikey", "seq", "loc")


def found(records: DataFrame, strip_salts: bool = True, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """All findings of several rows, and the rows behind them: KEY with HEAD, and KEY with WITHIN, seq and loc."""
    none = F.lit(None).cast("string")
    long = representations(records).select("pool", "representation", "value", "inchikey", F.col("loc.row_seq").alias("seq"), place("loc.").alias("loc"))
    long = materialise(long).withColumn("canonical_smiles", none)
    wanted = ["row_seq", "pool", "source_file", "row_index", "raw_smiles", "id_column", "identifier", "parse_error", "parse_error_category", "canonical_smiles", "inchikey", "parent_inchikey", "tautomer_key", "fp"]
    ids = materialise(identifier_rows(records).where("identifier is not null").select(*wanted))
    rows = ids.withColumn("seq", F.col("row_seq")).withColumn("loc", place(error=F.col("parse_error"), category=F.col("parse_error_category")))
    parsed, empty = rows.where(is_parsed()), F.coalesce(F.col("parse_error_category") == "empty", F.lit(False))
    keyed = parsed.withColumn("compound_key", checks.compound_key(strip_salts))
    near = rows.withColumn("key", text.near_duplicate_key(F.col("identifier")))
    forms = records.where(is_parsed() & F.col("inchikey").isNotNull()).withColumn("form", text.strip(F.col("raw_smiles"))).withColumn("seq", F.col("row_seq")).withColumn("loc", place())

    by_id, both = nested.BY_ID, F.col("train_rows") + F.col("test_rows")
    conflicts = checks.conflicting_identifiers(ids, strip_salts)
    alike = nested.best_similarity(parsed.join(conflicts.select(*by_id), by_id, "left_semi"))
    broken = checks.broken_identifiers(ids)
    role = lambda other: F.when(is_parsed(), "valid").otherwise(other)
    issue = lambda section, groups, source, value, part=None, **head: finding(section, groups, source, ["id_column", value], "id_column", value, None, part, **head)
    parts = [
        finding("duplicates", checks.repeated(long), long, ["pool", "representation", "value"], "representation", "value", "pool", rows="rows"),
        finding("duplicate_identifiers", checks.repeated_identifiers(ids), rows, ["pool", *by_id], "id_column", "identifier", "pool", rows="rows"),
        issue("one_id_multiple_structures", conflicts.join(alike, by_id, "left"), parsed, "identifier", rows="rows", kind="conflict_type", max_similarity="max_similarity"),
        issue("one_structure_multiple_ids", checks.shared_compounds(ids, strip_salts), keyed, "compound_key", F.col("identifier"), rows="rows", kind="conflict_type", canonical_smiles="canonical_smiles", inchikey="inchikey"),
        issue("near_duplicates", near.groupBy("id_column", "key").agg(F.count_distinct("identifier").alias("n"), F.count("*").alias("rows")).where("n > 1"), near, "key", F.col("identifier"), rows="rows"),
        issue("id_with_unparseable_and_valid_structures", broken.where("broken > 0"), rows.where(is_parsed() | ~empty), "identifier", role("unparseable"), rows=F.col("broken") + F.col("valid")),
        issue("missing_structure_resolvable_by_id", broken.where("missing > 0"), rows.where(is_parsed() | empty), "identifier", role("missing"), rows=F.col("missing") + F.col("valid"), ambiguous="ambiguous"),
        finding("inconsistent_smiles", checks.inconsistent_forms(records), forms, ["inchikey"], None, "inchikey", None, F.col("form"), rows="rows", canonical_smiles="canonical_smiles", inchikey="inchikey"),
    ]
    if not check:
        parts += [
            finding("leak_exact", checks.overlapping(long), long, ["representation", "value"], "representation", "value", rows=both),
            finding("leak_identifiers", checks.overlap_groups(rows, by_id), rows, by_id, "id_column", "identifier", rows=both),
        ]
    heads, behind = zip(*parts, strict=True)
    return reduce(DataFrame.unionByName, heads), reduce(DataFrame.unionByName, behind)


def single(records: DataFrame, id_columns: list[str]) -> DataFrame:
    """Findings of one row: section, name, pool, source_file, row_index, raw_smiles, details."""
    at = ["pool", "source_file", "row_index", "raw_smiles"]

    def rows(section: str, df: DataFrame, name: str, *details: str) -> DataFrame:
        said = F.map_filter(F.create_map(*[x for c in details for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
        return df.select(F.lit(section).alias("section"), F.col(name).alias("name"), *at, said.alias("details"))

    return (
        rows("unparseable_smiles", checks.unparseable(records, id_columns), "category", "parse_error", "resolvable_via_identifier")
        .unionByName(rows("quality_flags", checks.quality_flags(records), "category", "charge", "stereocentres", "stereo_bonds", "warning"))
        .unionByName(rows("identifier_whitespace", checks.identifier_whitespace(records), "id_column", "raw_value", "value")))


def parts_of(records: DataFrame, id_columns: list[str], strip_salts: bool = True, pairs: DataFrame | None = None, check: bool = False, page: int = pages.PAGE) -> dict[str, DataFrame]:
    """The parts of a report.  pairs: similar train and test rows (similarity, la, lb)."""
    heads, behind = found(records, strip_salts, check)
    out = {"findings": heads, "occurrences": pages.paged(behind, [*KEY, *WITHIN], "seq", F.col("loc"), page, "rows"), "rows": single(records, id_columns)}
    if pairs is not None:
        out["pairs"] = pairs.select(F.lit("tanimoto_similarity").alias("section"), F.col("la").alias("train"), F.col("lb").alias("test"), "similarity")
    return out


def hadoop(spark: SparkSession, path: str) -> tuple:
    """A path of any file system that Spark knows, and that file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Puts the manifest in place of the one before, in one rename."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    new, fs = hadoop(spark, f"{folder}/.{MANIFEST}-{manifest['run']}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(manifest, indent=2, default=str).encode()))
    stream.close()
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(new), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")), over)


def write(spark: SparkSession, parts: dict[str, DataFrame], folder: str, kind: str = "parquet", about: dict | None = None, per_file: int = 1_000_000) -> dict:
    """Writes the parts and then the manifest, which is returned; ``about`` is added to it."""
    folder, run = folder.rstrip("/"), f"run-{uuid.uuid4().hex}"
    manifest = {**(about or {}), "format": kind, "run": run, "parts": {}}
    for name, df in parts.items():
        seen, path = Observation(), f"{folder}/{run}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", per_file).option("compression", "gzip").partitionBy("section").format(FORMATS[kind]).save(path)
        at, fs = hadoop(spark, path)
        whole = fs.getContentSummary(at)
        manifest["parts"][name] = {"path": f"{run}/{name}", "rows": seen.get["n"], "files": whole.getFileCount() - 1, "bytes": whole.getLength(), "schema": df.schema.jsonValue()}
    commit(spark, folder, manifest)
    at, fs = hadoop(spark, folder)
    for status in fs.listStatus(at):
        if status.getPath().getName().startswith("run-") and status.getPath().getName() != run:
            fs.delete(status.getPath(), True)
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    at, fs = hadoop(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not fs.exists(at):
        raise SinkError(f"{folder} has no {MANIFEST}: no report was committed there")
    return json.loads("\n".join(r[0] for r in spark.read.text(str(at)).collect()))  # as long as a summary


def read(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """A part of the report that is committed in a folder."""
    manifest = manifest_of(spark, folder)
    if part not in manifest["parts"]:
        raise SinkError(f"the report in {folder} has no part {part}, only {', '.join(manifest['parts'])}")
    entry = manifest["parts"][part]
    return spark.read.schema(T.StructType.fromJson(entry["schema"])).format(FORMATS[manifest["format"]]).load(f"{folder.rstrip('/')}/{entry['path']}")
