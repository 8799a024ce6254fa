"""The nested report of an audit or a check, and its forms as text."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks, findings, nested, totals
from ..sources.shared import materialise
from ..sources.tables import describe
from . import sink
from .config import Config, audit_only

PLACE = ("pool", "source_file", "row_index", "raw_smiles")
EXTRA = {"net_charge": ("charge",), "undefined_stereo": ("stereocentres", "stereo_bonds"), "rdkit_warnings": ("warning",)}
NAMESPACE = ("one_id_multiple_structures", "one_structure_multiple_ids", "identifier_whitespace", "near_duplicates", "id_with_unparseable_and_valid_structures", "missing_structure_resolvable_by_id")


def collected(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def by(rows: list[dict], *keys: str) -> dict[tuple, list[dict]]:
    """Rows by the values of some keys, without these."""
    found: dict[tuple, list[dict]] = {}
    for row in rows:
        found.setdefault(tuple(row[k] for k in keys), []).append({k: v for k, v in row.items() if k not in keys})
    return found


def namespace_issues(records: DataFrame, id_columns: list[str], strip_salts: bool) -> dict[str, dict[str, list]]:
    shared = nested.one_structure_multiple_ids(records, strip_salts)
    white = checks.identifier_whitespace(records)
    tables = (
        collected(nested.one_id_multiple_structures(records, strip_salts), "identifier"),
        [{k: v for k, v in r.items() if k != "compound_key"} for r in collected(shared, "compound_key")],
        collected(white.select("id_column", *PLACE, "raw_value", "value"), *PLACE[:3]),
        collected(nested.near_duplicates(records), "key"),
        collected(nested.unparseable_and_valid(records), "identifier"),
        collected(nested.missing_resolvable(records), "identifier"),
    )
    parts = [by(rows, "id_column") for rows in tables]
    return {c: {name: part.get((c,), []) for name, part in zip(NAMESPACE, parts, strict=True)} for c in id_columns}


def summed(rows: list[dict], id_columns: list[str]) -> dict:
    """The summary's numbers, nested by path: those of every report in their order, and the kinds that are found within."""
    out: dict = {}
    for row in sorted(rows, key=lambda r: (r["place"] is None, r["place"], r["path"])):
        *head, last = row["path"]
        at = out
        for name in head:
            at = at.setdefault(name, {})
        at[last] = row["value"]
    out.setdefault("total_unparseable_by_category", {})
    issues = out.setdefault("total_identifier_namespace_issues", {})
    for c in id_columns:
        issues.setdefault(c, {}).setdefault("one_id_multiple_structures_by_type", {})
    return out


def tier(summary: list[dict], name: str) -> dict:
    rows = [r for r in summary if r["severity"] == name]
    whole = next(({k: r[k] for k in ("findings", "rows")} for r in rows if r["finding_type"] is None), {"findings": 0, "rows": 0})
    return {**whole, "by_type": {r["finding_type"]: {k: r[k] for k in ("findings", "rows")} for r in rows if r["finding_type"]}}


def echo(config: Config, resolved: dict[str, dict[str, str]], id_columns: list[str]) -> dict:
    label = lambda sources: [describe(x, i, 0 if isinstance(x, str | Path) else x.count() if isinstance(x, DataFrame) else len(x)) for i, x in enumerate(sources, 1)]
    pools = {"files": label(config.files)} if config.is_check else {"train_files": label(config.train), "test_files": label(config.test)}
    settings = {k: v for k, v in vars(config.settings).items() if not (config.is_check and k in audit_only())}
    return {**pools, "smiles_column": config.smiles_column, "resolved_smiles_columns": resolved["dataset"] if config.is_check else resolved, "identifier_columns": id_columns, **settings}


def summary_of(records: DataFrame, config: Config, id_columns: list[str], pairs: DataFrame | None) -> dict:
    """Status, tiers and totals: as many numbers as there are finding types, pools and identifier columns."""
    s = config.settings
    tiered = findings.tiered(findings.collect(records, s.strip_salts, pairs), s.max_train_test_similarity)
    kept = materialise(findings.maximal(materialise(tiered)))
    summary = collected(findings.tier_summary(kept), "severity", "finding_type")
    blocking, flagged = tier(summary, "FAIL"), tier(summary, "WARN")
    status = "FAIL" if blocking["findings"] else "WARN" if flagged["findings"] else "PASS"
    numbers = totals.totals(records, id_columns, s.strip_salts, pairs, config.is_check)
    return {"status": status, "blocking": blocking, "flagged": flagged, **summed(collected(numbers), id_columns)}


def heading(config: Config, id_columns: list[str], resolved: dict[str, dict[str, str]], summary: dict) -> dict:
    made = datetime.now(UTC).isoformat(timespec="seconds")
    return {"generated_at": made, "mode": "check" if config.is_check else "audit", "config": echo(config, resolved, id_columns), "summary": summary}


def to_folder(records: DataFrame, config: Config, id_columns: list[str], resolved: dict[str, dict[str, str]], pairs: DataFrame | None) -> dict:
    """Writes the report as files of its parts; returns what the driver holds of it, the manifest."""
    about = heading(config, id_columns, resolved, summary_of(records, config, id_columns, pairs))
    parts = sink.parts_of(records, id_columns, config.settings.strip_salts, pairs, config.is_check)
    return sink.write(records.sparkSession, parts, str(config.report_output), config.settings.report_format, about)


def build(records: DataFrame, config: Config, id_columns: list[str], resolved: dict[str, dict[str, str]], pairs: DataFrame | None) -> dict:
    """pairs: similar train and test rows of an audit (columns a, b, similarity, train, test, la, lb)."""
    s, check = config.settings, config.is_check
    pools = ["dataset"] if check else ["train", "test"]
    found = summary_of(records, config, id_columns, pairs)
    same, same_ids = by(collected(nested.duplicates(records), "value"), "pool", "representation"), by(collected(nested.identifier_duplicates(records), "value"), "pool", "id_column")
    duplicates = {p: {**{r: same.get((p, r), []) for r in V.REPRESENTATIONS}, "identifiers": {c: same_ids.get((p, c), []) for c in id_columns}} for p in pools}
    flags = by(collected(checks.quality_flags(records), "row_seq"), "pool", "category")
    shown = lambda p, q: [{"pool": p, **{k: f[k] for k in (*PLACE[1:], *EXTRA.get(q, ()))}} for f in flags.get((p, q), [])]
    quality = {p: {q: shown(p, q) for q in V.QUALITY_FLAGS} for p in pools}
    namespace = namespace_issues(records, id_columns, s.strip_salts)
    bad = collected(checks.unparseable(records, id_columns).withColumnRenamed("parse_error", "error"), "row_seq")
    bad = [{k: v for k, v in b.items() if k != "row_seq"} for b in bad]
    forms = collected(nested.inconsistent(records), "inchikey")
    report: dict = {**heading(config, id_columns, resolved, found), "unparseable_smiles": bad, "inconsistent_smiles": forms}
    if not check:
        exact, by_id = by(collected(nested.overlaps(records), "value"), "representation"), by(collected(nested.identifier_overlaps(records), "value"), "id_column")
        alike = pairs.orderBy(F.desc("similarity"), "a", "b").select(F.col("la").alias("train"), F.col("lb").alias("test"), "similarity").collect()
        leakage = {
            "exact": {r: exact.get((r,), []) for r in V.REPRESENTATIONS}, "identifiers": {c: by_id.get((c,), []) for c in id_columns},
            "tanimoto_similarity": [r.asDict(recursive=True) for r in alike],
        }
        report["train_test_leakage"] = leakage
    report["internal_duplicates"] = duplicates["dataset"] if check else duplicates
    report["identifier_namespace_issues"] = namespace
    report["quality_flags"] = quality["dataset"] if check else quality
    return report


# Text


def severity_of(kind: str, pool: str | None, report: dict) -> str:
    if kind == "tanimoto_similarity":
        return "WARN" if report["config"]["max_train_test_similarity"] >= 1.0 else "FAIL"
    return "FAIL" if kind in V.ALWAYS_FAIL or (kind in V.FAIL_IN_TEST and pool == "test") else "WARN"


def place(o: dict) -> str:
    more = "".join(f", {k} {v:+d}" if k == "charge" else f", {k} {v}" for k, v in o.items() if k not in PLACE and v is not None and not isinstance(v, list | dict))
    return f"[{o['pool']}] {o['source_file']} (row {o['row_index']}): {o['raw_smiles']!r}{more}"


def entry(tag: str, title: str, value: dict) -> list[str]:
    """One finding: a line with its tier, then its lists, each element with the rows behind it."""
    said = {k: v for k, v in value.items() if not isinstance(v, list) and v is not None}
    lines = [f"  [{tag}] {title}" + "".join(f"  {k}={round(v, 3) if isinstance(v, float) else v}" for k, v in said.items())]
    for name, rows in value.items():
        if not isinstance(rows, list):
            continue
        for r in rows:
            if isinstance(r, dict) and "row_index" in r:
                lines.append(f"      {name}: {place(r)}")
            elif isinstance(r, dict):
                lines.append(f"      {name}: " + ", ".join(str(v) for v in r.values() if not isinstance(v, list)))
                lines += [f"        {place(o)}" for o in r.get("occurrences", [])]
    return lines


def section(title: str, lines: list[str]) -> list[str]:
    return ["", title, "-" * len(title), *(lines or ["  (none)"])]


def sections(report: dict) -> list[tuple[str, list[str]]]:
    """Titles and lines of all findings, each with the tier it counts in."""
    check = report["mode"] == "check"
    tag = lambda kind, pool=None: severity_of(kind, pool, report)
    out = [("Unparseable SMILES", [f"  [{tag('unparseable_smiles')}] {b['category']}: {place({k: v for k, v in b.items() if k != 'category'})}" for b in report["unparseable_smiles"]])]
    out.append(("Inconsistent SMILES", [x for f in report["inconsistent_smiles"] for x in entry(tag("inconsistent_smiles"), "structure", f)]))
    if not check:
        leak = report["train_test_leakage"]
        kinds = {r: V.OVERLAP_FINDINGS.get(r, "exact_overlap") for r in V.REPRESENTATIONS}
        for title, some in (("exact matches", ["exact_overlap"]), ("salt forms", ["salt_form_overlap"]), ("stereoisomers", ["stereo_overlap"])):
            out.append((f"Train-test leakage: {title}", [x for r, k in kinds.items() if k in some for f in leak["exact"][r] for x in entry(tag(k), r, f)]))
        out.append(("Train-test leakage: identifiers", [x for c, rows in leak["identifiers"].items() for f in rows for x in entry(tag("identifier_overlap"), c, f)]))
        alike = [x for f in leak["tanimoto_similarity"] for x in entry(tag("tanimoto_similarity"), "pair", {"similarity": f["similarity"], "rows": [f["train"], f["test"]]})]
        out.append(("Train-test leakage: similar structures", alike))
    for pool in ["dataset"] if check else ["train", "test"]:
        same = report["internal_duplicates"] if check else report["internal_duplicates"][pool]
        lines = [x for r in V.REPRESENTATIONS for f in same[r] for x in entry(tag(V.DUPLICATE_FINDINGS.get(r, "duplicate_structure"), pool), r, f)]
        lines += [x for c, rows in same["identifiers"].items() for f in rows for x in entry(tag("duplicate_identifier", pool), c, f)]
        out.append((f"Duplicates: {pool}", lines))
        flags = report["quality_flags"] if check else report["quality_flags"][pool]
        named = {q: f"[{tag(V.QUALITY_FINDINGS[q], pool)}]" if q in V.QUALITY_FINDINGS else "[total]" for q in flags}
        out.append((f"Quality flags: {pool}", [f"  {named[q]} {q}: {place(f)}" for q, rows in flags.items() for f in rows]))
    lines = []
    for c, kinds in report["identifier_namespace_issues"].items():
        for name, rows in kinds.items():
            for f in rows:
                kind = {"near_duplicates": "identifier_near_duplicate"}.get(name, name)
                if name == "one_id_multiple_structures" and f["conflict_type"] != "different_compound":
                    kind = "one_id_structure_variants"
                lines += [f"  [{tag(kind)}] {c} {name}: {f['raw_value']!r}: {place(f)}"] if name == "identifier_whitespace" else entry(tag(kind), f"{c} {name}", f)
    out.append(("Identifiers", lines))
    return out


# The dashboard: a banner, and a table for each family of checks


def table_of(header: list[str], rows: list[list[str]]) -> list[str]:
    """Aligned columns, the first to the left and the others to the right."""
    widths = [max(len(r[k]) for r in [header, *rows]) for k in range(len(header))]
    line = lambda r: "  " + "  ".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(r, widths, strict=True))).rstrip()
    return [line(header), "  " + "  ".join("-" * w for w in widths), *map(line, rows)]


def cell(count: int, tier: str) -> str:
    return f"{tier} {count}" if count else "ok 0"


def banner(summary: dict) -> str:
    said = [f"{summary[t]['findings']} {word} finding(s) in {summary[t]['rows']} row(s)" for t, word in (("blocking", "blocking"), ("flagged", "flagged")) if summary[t]["findings"]]
    return f"OVERALL {summary['status']}" + (": " + "; ".join(said) if said else ": nothing found")


def severity_table(summary: dict) -> list[str]:
    rows = [[k, tag, str(v["findings"]), str(v["rows"])] for tag, t in (("FAIL", "blocking"), ("WARN", "flagged")) for k, v in summary[t]["by_type"].items()]
    return table_of(["finding type", "tier", "findings", "rows"], rows) if rows else []


def leakage_table(report: dict) -> list[str]:
    s, tag = report["summary"], lambda kind: severity_of(kind, None, report)
    kinds = (("exact", "same structure", "exact_overlap"), ("salt_form", "other salt form only", "salt_form_overlap"), ("stereo", "other stereochemistry only", "stereo_overlap"))
    rows = [[f"rows in both pools: {label}", *(cell(s[f"total_{k}_leaked_{p}_molecules"], tag(f)) for p in ("train", "test"))] for k, label, f in kinds]
    rows.append(["identifiers in both pools", cell(s["total_identifier_leakage_events"], tag("identifier_overlap")), ""])
    rows.append(["pairs of similar structures", cell(s["total_tanimoto_leakage_pairs"], tag("tanimoto_similarity")), ""])
    return table_of(["leakage", "train", "test"], rows)


def duplicates_table(report: dict, ends: dict[str, str]) -> list[str]:
    s, row = report["summary"], lambda label, kind, of: [label, *(cell(of(end), severity_of(kind, pool, report)) for pool, end in ends.items())]
    rows = [row(r, V.DUPLICATE_FINDINGS.get(r, "duplicate_structure"), lambda end, r=r: s[f"total_internal_duplicates{end}"][r]) for r in V.REPRESENTATIONS]
    columns = report["config"]["identifier_columns"]
    rows += [row(f"identifier {c}", "duplicate_identifier", lambda end, c=c: s[f"total_internal_duplicates{end}_identifiers"].get(c, 0)) for c in columns]
    return table_of(["duplicates", *ends], rows)


def namespace_table(report: dict) -> list[str]:
    """Issues by identifier column; several structures of an identifier are split by tier."""
    issues, tag = report["summary"]["total_identifier_namespace_issues"], lambda kind: severity_of(kind, None, report)
    different = lambda x: x["one_id_multiple_structures_by_type"].get("different_compound", 0)
    kinds = [
        ("an id with different compounds", "one_id_multiple_structures", different),
        ("an id with variants of a compound", "one_id_structure_variants", lambda x: x["one_id_multiple_structures"] - different(x)),
        *[(label, {"near_duplicates": "identifier_near_duplicate"}.get(k, k), lambda x, k=k: x[k]) for k, label in ISSUE_LABELS.items()],
    ]
    return table_of(["identifiers", *issues], [[label, *(cell(of(x), tag(kind)) for x in issues.values())] for label, kind, of in kinds]) if issues else []


ISSUE_LABELS = {
    "one_structure_multiple_ids": "a compound with several ids", "id_with_unparseable_and_valid_structures": "an id with broken and valid rows",
    "missing_structure_resolvable_by_id": "an id that fills empty structures", "near_duplicates": "ids that are almost equal", "identifier_whitespace": "ids with white space around",
}


def quality_table(report: dict, ends: dict[str, str]) -> list[str]:
    flags = report["summary"]["total_quality_flags"]
    count = lambda q, pool: flags[q] if report["mode"] == "check" else flags[q][pool]
    return table_of(["quality", *ends], [[q.replace("_", " "), *(cell(count(q, p), severity_of(kind, p, report)) for p in ends)] for q, kind in V.QUALITY_FINDINGS.items()])


def parsing_lines(summary: dict) -> list[str]:
    pools = [f"{p} {summary[f'total_unparseable_{p}']}" for p in ("train", "test") if f"total_unparseable_{p}" in summary]
    kinds = [f"{k} {n}" for k, n in summary["total_unparseable_by_category"].items()]
    line = f"  rows that do not parse: {summary['total_unparseable']}" + "".join(f" ({', '.join(x)})" for x in (pools, kinds) if x)
    if n := summary["total_unparseable_resolvable_via_identifier"]:
        line += f", {n} to be filled by an identifier"
    return [line, f"  structures written in several ways: {summary['total_inconsistent_smiles']}"]


def dashboard(report: dict) -> str:
    """The banner, rows processed, and tables of findings by type, leakage, duplicates, identifiers and quality; needs the summary only."""
    s, check = report["summary"], report["mode"] == "check"
    ends = {"dataset": ""} if check else {"train": "_train", "test": "_test"}
    rows = [f"{p} {s['total_rows' if check else f'total_{p}_rows']}" for p in ends]
    parts = [severity_table(s), [] if check else leakage_table(report), duplicates_table(report, ends), namespace_table(report), quality_table(report, ends)]
    lines = ["=" * 60, f"sieveline {report['mode']} summary", "=" * 60, banner(s), f"Rows processed: {', '.join(rows)}", *parsing_lines(s)]
    return "\n".join(lines + [x for part in parts if part for x in ["", *part]])


def render(report: dict) -> str:
    lines = [dashboard(report), f"generated {report['generated_at']}"]
    lines += [f"  {k}: {v}" for k, v in report["config"].items()]
    for title, body in sections(report):
        lines += section(title, body)
    return "\n".join(lines) + "\n"


def save(report: dict, output: str | Path, kind: str) -> None:
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(render(report) if kind == "txt" else json.dumps(report, indent=2, default=str))
