"""All findings as one long relation (finding_type, pool, sid, row), tiered, reduced to maximal row sets and summed up.

A finding's rows stay rows: no list of them is ever built, so a finding may be about any number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import materialise
from . import checks
from .records import identifier_rows, is_parsed, representations, row_key

ROW = "struct<pool:string,source_file:string,row_index:bigint>"
SET = ["severity", "finding_type"]


def severity(similarity: float = 1.0) -> Column:
    """FAIL or WARN of (finding_type, pool); a pool-dependent type without a pool has none."""
    t = F.col("finding_type")
    tanimoto = "WARN" if similarity >= 1.0 else "FAIL"
    return (
        F.when(t.isin(V.ALWAYS_FAIL), "FAIL").when(t.isin(V.ALWAYS_WARN), "WARN").when(t == "tanimoto_similarity", tanimoto)
        .when(t.isin(V.FAIL_IN_TEST) & F.col("pool").isNotNull(), F.when(F.col("pool") == "test", "FAIL").otherwise("WARN")))


def members(rows: DataFrame, kind: Column | str, keys: list[Column | str], row: Column, pool: Column | None = None) -> DataFrame:
    """Rows of findings; all rows with the same kind, pool and keys are of one finding."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    pool = F.lit(None).cast("string") if pool is None else pool
    named = [F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")).cast("string") for k in keys]
    sid = F.md5(F.concat_ws("\x01", kind, pool, *named))
    return rows.select(kind.alias("finding_type"), pool.alias("pool"), sid.alias("sid"), row.cast(ROW).alias("row"))


def named(kinds: dict[str, str], otherwise: str) -> Column:
    return reduce(lambda c, kv: c.when(F.col("representation") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), "")).otherwise(otherwise)


def collect(records: DataFrame, strip_salts: bool = True, similar: DataFrame | None = None) -> DataFrame:
    """Every finding of every check with the rows that it is about."""
    loc = F.struct("loc.pool", "loc.source_file", "loc.row_index")
    row, own = row_key(), ["pool", "source_file", "row_index"]
    long = materialise(representations(records).select("loc", "pool", "inchikey", "representation", "value"))
    ids = materialise(identifier_rows(records).where("identifier is not null").select(
        "id_column", "identifier", *own, "row_seq", "parse_error", "parse_error_category", "canonical_smiles", "inchikey", "parent_inchikey", "tautomer_key"))
    bad, empty = ~is_parsed(), F.col("parse_error_category") == "empty"
    parsed = ids.where(is_parsed())
    flags = checks.quality_flags(records).where(~F.col("category").isin(V.QUALITY_TOTALS))
    names = F.create_map(*[F.lit(x) for kv in V.QUALITY_FINDINGS.items() for x in kv])
    near = ids.withColumn("key", checks.text.near_duplicate_key(F.col("identifier")))
    broken = checks.broken_identifiers(ids)
    by_id, by_value = ["id_column", "identifier"], ["representation", "value"]

    def of(groups: DataFrame, rows: DataFrame, keys: list[str], kind: Column | str, row: Column = row, pool: Column | None = None) -> DataFrame:
        return members(rows.join(groups, keys), kind, keys, row, pool)

    conflict = F.when(F.col("conflict_type") == "different_compound", "one_id_multiple_structures").otherwise("one_id_structure_variants")
    found = [
        members(records.where(bad), "unparseable_smiles", own, row),
        of(checks.inconsistent_forms(records).select("inchikey"), records.where(is_parsed()), ["inchikey"], "inconsistent_smiles"),
        of(checks.overlapping(long).select(*by_value), long, by_value, named(V.OVERLAP_FINDINGS, "exact_overlap"), loc),
        of(checks.overlap_groups(ids, by_id).select(*by_id), ids, by_id, "identifier_overlap"),
        of(checks.repeated(long).select("pool", *by_value), long, ["pool", *by_value], named(V.DUPLICATE_FINDINGS, "duplicate_structure"), loc, F.col("pool")),
        of(checks.repeated_identifiers(ids).select("pool", *by_id), ids, ["pool", *by_id], "duplicate_identifier", row, F.col("pool")),
        members(flags, names[F.col("category")], own, row, F.col("pool")),
        of(checks.conflicting_identifiers(ids, strip_salts).select(*by_id, "conflict_type"), parsed, by_id, conflict),
        of(checks.shared_compounds(ids, strip_salts).select("id_column", "compound_key"), parsed.withColumn("compound_key", checks.compound_key(strip_salts)), ["id_column", "compound_key"], "one_structure_multiple_ids"),
        members(checks.identifier_whitespace(records), "identifier_whitespace", ["id_column", *own], row),
        of(near.groupBy("id_column", "key").agg(F.count_distinct("identifier").alias("n")).where("n > 1").select("id_column", "key"), near, ["id_column", "key"], "identifier_near_duplicate"),
        of(broken.where("broken > 0").select(*by_id), ids.where(is_parsed() | ~empty), by_id, "id_with_unparseable_and_valid_structures"),
        of(broken.where("missing > 0").select(*by_id), ids.where(bad & empty), by_id, "missing_structure_resolvable_by_id"),
    ]
    if similar is not None:  # rows train and test are structs of row identity
        both = similar.select(F.to_json(F.struct("train", "test")).alias("pair"), F.explode(F.array("train", "test")).alias("side"))
        found.append(members(both, "tanimoto_similarity", ["pair"], F.col("side")))
    return reduce(DataFrame.unionByName, found)


def tiered(found: DataFrame, similarity: float = 1.0) -> DataFrame:
    """(severity, finding_type, sid, row) of distinct row sets: of findings of one tier and type with equal rows one stays.

    Sets are told by their number of rows and a 128-bit digest of these.
    """
    rows = found.withColumn("severity", severity(similarity)).select(*SET, "sid", "row").distinct()
    digest = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    sets = rows.groupBy(*SET, "sid").agg(F.count("*").alias("n"), *digest)
    first = sets.groupBy(*SET, "n", "h1", "h2").agg(F.min("sid").alias("sid"))
    return rows.join(first.select(*SET, "sid"), [*SET, "sid"], "left_semi")


def maximal(rows: DataFrame) -> DataFrame:
    """Of the sets of (severity, finding_type, sid, row), distinct ones: the rows of those that no other set of the type contains.

    A set can only be contained in a larger one that has the set's least frequent row.  These pairs of set ids are the candidates; a
    candidate holds the set if as many of the set's rows are in it as the set has.
    """
    sized = rows.join(rows.groupBy(*SET, "sid").agg(F.count("*").alias("n")), [*SET, "sid"])
    often = sized.groupBy(*SET, "row").agg(F.count("*").alias("sets"), F.max("n").alias("most"))
    rare = sized.join(often, [*SET, "row"]).groupBy(*SET, "sid", "n").agg(F.min(F.struct("sets", "most", "row")).alias("rare"), F.min("most").alias("most"))
    # Where some row's largest set has this one's size, nothing larger holds the set.
    asked = rare.where("most > n").select(*SET, "sid", "n", F.col("rare.row").alias("row"))
    larger = sized.select(*SET, F.col("sid").alias("big"), F.col("n").alias("m"), "row")
    pairs = asked.join(larger, [*SET, "row"]).where("m > n").select("sid", "big", "n")
    mine, theirs = rows.select("sid", "row").join(pairs, "sid"), rows.select(F.col("sid").alias("big"), "row")
    within = mine.join(theirs, ["big", "row"]).groupBy("sid", "big", "n").agg(F.count("*").alias("common")).where("common = n")
    return rows.join(within.select("sid").distinct(), "sid", "left_anti")


def tier_summary(kept: DataFrame) -> DataFrame:
    """Findings and distinct rows per tier and type, and per tier (finding_type null: the union of its rows).

    The number of a row is that of its source (there are as many as the user listed) and its index within; the rows of a type are
    bitmaps of 32,768 numbers each, made before anything is shuffled, and a union is the OR of these.
    """
    sources = kept.select("row.pool", "row.source_file").distinct().withColumn("source", F.row_number().over(Window.orderBy("pool", "source_file")))
    same = F.col("row.pool").eqNullSafe(F.col("pool")) & F.col("row.source_file").eqNullSafe(F.col("source_file"))
    nr = F.shiftleft(F.col("source").cast("long"), 40) + F.col("row.row_index") + F.lit(1 << 39)
    rows = kept.join(sources, same).select(*SET, F.bitmap_bucket_number(nr).alias("bucket"), F.bitmap_bit_position(nr).alias("bit"))
    maps = materialise(rows.groupBy(*SET, "bucket").agg(F.bitmap_construct_agg("bit").alias("map")))
    sets = kept.select(*SET, "sid").distinct().groupBy(*SET).agg(F.count("*").alias("findings"))
    by_type = sets.join(maps.groupBy(*SET).agg(F.sum(F.bitmap_count("map")).alias("rows")), SET)
    union = maps.groupBy("severity", "bucket").agg(F.bitmap_or_agg("map").alias("map")).groupBy("severity").agg(F.sum(F.bitmap_count("map")).alias("rows"))
    by_tier = sets.groupBy("severity").agg(F.sum("findings").alias("findings")).join(union, "severity")
    return by_type.unionByName(by_tier.withColumn("finding_type", F.lit(None).cast("string")))


def status(kept: DataFrame) -> DataFrame:
    """One row: FAIL if a finding blocks, else WARN if there is one, else PASS."""
    return kept.agg(F.when(F.max(F.col("severity") == "FAIL"), "FAIL").when(F.count("*") > 0, "WARN").otherwise("PASS").alias("status"))
