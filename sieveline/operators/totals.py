"""The numbers of a report's summary as one relation: every counted thing is a row of an area with up to three dimensions, counted
once in full and then over all sets of dimensions that some number needs.

Numbers are named by a path; those that a report always has are there with 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import materialise
from . import checks
from .records import identifier_rows, representations

ISSUES = ("one_id_multiple_structures", "one_structure_multiple_ids", "identifier_whitespace", "near_duplicates", "id_with_unparseable_and_valid_structures", "missing_structure_resolvable_by_id")
LEAKS = ("exact", "salt_form", "stereo")
OWN_TOTALS = ("mixtures", "salts_or_metal_complexes", "suspicious_fragments")  # quality flags with a total of their own
# What a set of dimensions leaves out, as grouping_id over (area, pool, name, kind) says it.
AREA, BY_POOL, BY_NAME, BY_POOL_NAME, BY_KIND, IN_FULL = 7, 3, 5, 1, 6, 0
SETS = [["area"], ["area", "pool"], ["area", "name"], ["area", "pool", "name"], ["area", "kind"], ["area", "pool", "name", "kind"]]


def counted(records: DataFrame, id_columns: list[str], strip_salts: bool, pairs: DataFrame | None, check: bool) -> DataFrame:
    """Rows (area, pool, name, kind, n).  For issues of identifiers, ``pool`` is the identifier column."""
    long = materialise(representations(records).select("loc", "pool", "inchikey", "representation", "value"))
    ids = materialise(identifier_rows(records).where("identifier is not null"))

    def area(rows: DataFrame, name: str, pool: Column | str | None = None, what: Column | str | None = None, kind: Column | str | None = None) -> DataFrame:
        named = zip(("pool", "name", "kind"), (pool, what, kind), strict=True)
        some = [(F.col(c) if isinstance(c, str) else F.lit(None) if c is None else c).cast("string").alias(n) for n, c in named]
        return rows.select(F.lit(name).alias("area"), *some).groupBy("area", "pool", "name", "kind").agg(F.count("*").alias("n"))

    def issue(rows: DataFrame, number: int, kind: str | None = None) -> DataFrame:
        return area(rows, "issues", "id_column", F.lit(ISSUES[number]), kind)

    broken = checks.broken_identifiers(ids)
    near = ids.withColumn("key", checks.text.near_duplicate_key(F.col("identifier"))).groupBy("id_column", "key").agg(F.count_distinct("identifier").alias("n"))
    bad = checks.unparseable(records, id_columns)
    parts = [
        area(records, "rows", "pool"),
        area(bad, "unparseable", "pool", "category", F.when(F.col("resolvable_via_identifier").isNotNull(), "resolvable").otherwise("not")),
        area(checks.inconsistent_forms(records), "inconsistent"),
        area(checks.repeated(long), "duplicates", "pool", "representation"),
        area(checks.repeated_identifiers(ids), "duplicate_identifiers", "pool", "id_column"),
        area(checks.quality_flags(records), "quality", "pool", "category"),
        issue(checks.conflicting_identifiers(ids, strip_salts), 0, "conflict_type"),
        issue(checks.shared_compounds(ids, strip_salts), 1),
        issue(checks.identifier_whitespace(records), 2),
        issue(near.where("n > 1"), 3),
        issue(broken.where("broken > 0"), 4),
        issue(broken.where("missing > 0"), 5),
    ]
    if not check:
        parts += [area(checks.leaked_rows(records, checks.overlapping(long)), "leaked", "pool", "kind"), area(checks.overlap_groups(ids, ["id_column", "identifier"]), "identifier_leakage")]
        if pairs is not None:
            parts.append(area(pairs, "pairs"))
    return reduce(DataFrame.unionByName, parts)


def paths(check: bool) -> Column:
    """The names of a number of an area over a set of dimensions: a list of paths, empty where a report has no such number."""
    path = lambda *parts: F.array(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    pool, name, kind = F.col("pool"), F.col("name"), F.col("kind")
    total = lambda *parts: F.concat(F.lit("total_"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    end = "" if check else F.concat(F.lit("_"), pool)
    is_a = lambda area, level: (F.col("area") == area) & (F.col("level") == level)
    flags = path("total_quality_flags", name) if check else path("total_quality_flags", name, pool)
    with_own = flags if check else F.when(name.isin(*OWN_TOTALS), F.concat(flags, path(total(name), pool))).otherwise(flags)
    first = F.lit(ISSUES[0])
    found = (
        F.when(is_a("rows", BY_POOL), path("total_rows") if check else path(total(pool, "_rows")))
        .when(is_a("unparseable", AREA), path("total_unparseable"))
        .when(is_a("unparseable", BY_NAME), path("total_unparseable_by_category", name))
        .when(is_a("unparseable", BY_KIND) & (kind == "resolvable"), path("total_unparseable_resolvable_via_identifier"))
        .when(is_a("inconsistent", AREA), path("total_inconsistent_smiles"))
        .when(is_a("duplicates", BY_POOL_NAME), path(total("internal_duplicates", end), name))
        .when(is_a("duplicate_identifiers", BY_POOL_NAME), path(total("internal_duplicates", end, "_identifiers"), name))
        .when(is_a("quality", BY_POOL_NAME), with_own)
        .when(is_a("issues", BY_POOL_NAME), path("total_identifier_namespace_issues", pool, name))
        .when(is_a("issues", IN_FULL) & (name == first), path("total_identifier_namespace_issues", pool, F.concat(first, F.lit("_by_type")), kind))
        .when(is_a("leaked", BY_POOL_NAME), path(total(name, "_leaked_", pool, "_molecules")))
        .when(is_a("identifier_leakage", AREA), path("total_identifier_leakage_events"))
        .when(is_a("pairs", AREA), path("total_tanimoto_leakage_pairs"))
    )
    return found if check else found.when(is_a("unparseable", BY_POOL), path(total("unparseable_", pool)))


def expected(id_columns: list[str], check: bool) -> list[list[str]]:
    """The paths of the numbers that every report has, in its order."""
    pools = ["dataset"] if check else ["train", "test"]
    out = [["total_rows"]] if check else [[f"total_{p}_rows"] for p in pools]
    out += [["total_unparseable"], *([] if check else [[f"total_unparseable_{p}"] for p in pools])]
    out += [["total_unparseable_resolvable_via_identifier"], ["total_inconsistent_smiles"]]
    for p in pools:
        end = "" if check else f"_{p}"
        out += [[f"total_internal_duplicates{end}", r] for r in V.REPRESENTATIONS]
        out += [[f"total_internal_duplicates{end}_identifiers", c] for c in id_columns]
    out += [["total_identifier_namespace_issues", c, i] for c in id_columns for i in ISSUES]
    out += [["total_quality_flags", q, *([] if check else [p])] for q in V.QUALITY_FLAGS for p in pools]
    if not check:
        out += [[f"total_{q}", p] for q in OWN_TOTALS for p in pools]
        out += [[f"total_{k}_leaked_{p}_molecules"] for k in LEAKS for p in pools]
        out += [["total_identifier_leakage_events"], ["total_tanimoto_leakage_pairs"]]
    return out


def totals(records: DataFrame, id_columns: list[str], strip_salts: bool = True, pairs: DataFrame | None = None, check: bool = False) -> DataFrame:
    """path (array<string>), value, place (of numbers that every report has; null for the others)."""
    full = counted(records, id_columns, strip_salts, pairs, check)
    summed = full.groupingSets(SETS, "area", "pool", "name", "kind").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))
    found = summed.select(F.explode(paths(check)).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))
    always = records.sparkSession.createDataFrame([(p, k) for k, p in enumerate(expected(id_columns, check))], "path array<string>, place int")
    return found.join(always, "path", "full").select("path", F.coalesce("n", F.lit(0)).alias("value"), "place")
