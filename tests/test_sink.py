"""Reports as files: what is written is the report, a manifest makes it valid, and an interrupted run changes nothing."""

import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators.records import complete
from sieveline.plans import audit, sink
from sieveline.plans import report as reports
from sieveline.plans.config import ConfigError

TRAIN = pd.DataFrame({"SMILES": ["CCCO", "OCCC", "CCCO", "C1CC", "", "CCCN", "CCCN.Cl"], "code": ["A1", "A2", "A3", "A4", "A2", "A5", "A5 "]})
TEST = pd.DataFrame({"SMILES": ["CCCO", "CCCCl", "CCCCBr"], "code": ["B1", "A5", "b-1"]})


@pytest.fixture(scope="module")
def whole(spark):
    return audit.audit(spark, TRAIN, TEST, identifier_columns=["code"], print_report=False)


def test_a_report_as_files_is_the_report(spark, tmp_path, whole):
    folder, want = str(tmp_path / "report"), whole
    made = audit.audit(spark, TRAIN, TEST, identifier_columns=["code"], report_output=folder, report_format="jsonl", print_report=False)
    assert made == json.loads((tmp_path / "report" / "manifest.json").read_text()) and made["summary"] == want["summary"]
    heads, behind, rows, pairs = (sink.read(spark, folder, p) for p in ("findings", "occurrences", "rows", "pairs"))
    assert [made["parts"][p]["rows"] for p in ("findings", "occurrences", "rows", "pairs")] == [df.count() for df in (heads, behind, rows, pairs)]
    assert pairs.count() == len(want["train_test_leakage"]["tanimoto_similarity"])
    # Findings by section and name, each with its rows in order.
    listed = {}
    for r in sorted(behind.collect(), key=lambda r: r["page"]):
        listed.setdefault((r["section"], r["pool"], r["name"], r["value"]), []).extend((o["pool"], o["row_index"], o["raw_smiles"]) for o in r["rows"])
    got = {k: sorted(v) for k, v in listed.items()}
    place = lambda o: (o["pool"], o["row_index"], o["raw_smiles"])
    expected = {}
    for name, found in [*want["train_test_leakage"]["exact"].items(), *want["train_test_leakage"]["identifiers"].items()]:
        section = "leak_identifiers" if name == "code" else "leak_exact"
        expected |= {(section, None, name, f["value"]): sorted(map(place, f["train_occurrences"] + f["test_occurrences"])) for f in found}
    for pool, same in want["internal_duplicates"].items():
        for name, found in [*((k, v) for k, v in same.items() if k != "identifiers"), *same["identifiers"].items()]:
            expected |= {("duplicate_identifiers" if name == "code" else "duplicates", pool, name, f["value"]): sorted(map(place, f["occurrences"])) for f in found}
    assert {k: v for k, v in got.items() if k[0].startswith(("leak", "duplicate"))} == expected
    issues = want["identifier_namespace_issues"]["code"]
    conflicts = {r["value"]: (r["kind"], r["max_similarity"]) for r in heads.where("section = 'one_id_multiple_structures'").collect()}
    assert conflicts == {c["identifier"]: (c["conflict_type"], c["max_similarity"]) for c in issues["one_id_multiple_structures"]} and conflicts
    assert heads.where("section = 'missing_structure_resolvable_by_id'").select("value", "ambiguous").collect() == [("A2", False)]
    assert {(r["section"], r["name"]) for r in rows.where("section = 'unparseable_smiles'").collect()} == {("unparseable_smiles", b["category"]) for b in want["unparseable_smiles"]}
    assert rows.where("section = 'identifier_whitespace'").select("details").first()[0] == {"raw_value": "A5 ", "value": "A5"}


def test_an_interrupted_run_leaves_the_report_before(spark, tmp_path):
    folder = str(tmp_path / "r")
    part = lambda n: {"rows": spark.range(n).select(F.lit("s").alias("section"), "id")}
    with pytest.raises(sink.SinkError):
        sink.read(spark, folder, "rows")
    first = sink.write(spark, part(10), folder, "jsonl")
    broken = spark.range(100).select(F.lit("s").alias("section"), F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sink.write(spark, {"rows": broken}, folder, "jsonl")
    assert sink.manifest_of(spark, folder)["run"] == first["run"] and sink.read(spark, folder, "rows").count() == 10
    second = sink.write(spark, part(30), folder, "parquet", {"mode": "check"}, per_file=4)
    assert sink.read(spark, folder, "rows").agg(F.sum("id")).first()[0] == 435 and second["mode"] == "check" and second["parts"]["rows"]["files"] >= 8
    assert [p.name for p in Path(folder).iterdir() if p.name.startswith("run-")] == [second["run"]]
    with pytest.raises(sink.SinkError):
        sink.read(spark, folder, "pages")


def test_hot_values_and_empty_tables(spark, tmp_path):
    """A value on a third of all rows is written in pages; a table without rows gives parts without rows."""
    ids = F.create_map(F.lit("code"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))))
    rows = spark.range(3000).select(F.col("id").alias("row_seq"), F.lit("dataset").alias("pool"), F.lit("f").alias("source_file"), F.col("id").alias("row_index"), F.concat(F.lit("C"), F.col("id")).alias("raw_smiles"),
        ids.alias("identifiers"), ids.alias("raw_identifiers"), F.lit("x").alias("parse_error"), F.lit("other").alias("parse_error_category"))
    sink.write(spark, sink.parts_of(complete(rows), ["code"], check=True, page=64), str(tmp_path / "hot"))
    found = sink.read(spark, str(tmp_path / "hot"), "occurrences").where("section = 'duplicate_identifiers'").orderBy("page").collect()
    assert [o["row_index"] for r in found for o in r["rows"]] == list(range(0, 3000, 3)) and max(len(r["rows"]) for r in found) == 64
    assert sink.read(spark, str(tmp_path / "hot"), "findings").select("section", "value", "rows").collect() == [("duplicate_identifiers", "hot", 1000)]
    made = sink.write(spark, sink.parts_of(complete(rows.limit(0)), ["code"], check=True), str(tmp_path / "none"), "jsonl")
    assert [p["rows"] for p in made["parts"].values()] == [0, 0, 0] and sink.read(spark, str(tmp_path / "none"), "findings").count() == 0


def test_dashboard_and_settings(spark, capsys, whole):
    report, out = whole, reports.dashboard(whole)
    s = report["summary"]
    assert f"OVERALL FAIL: {s['blocking']['findings']} blocking finding(s)" in out and "Rows processed: train 7, test 3" in out

    assert next(x for x in out.splitlines() if "same structure" in x).split()[-4:] == ["FAIL", "3", "FAIL", "1"]
    assert "rows that do not parse: 2 (train 2, test 0)" in out and "1 to be filled by an identifier" in out
    for kind in [*s["blocking"]["by_type"], *s["flagged"]["by_type"]]:
        assert kind in out
    assert not capsys.readouterr().out
    audit.check(spark, TRAIN.iloc[:1])
    out = capsys.readouterr().out
    assert "OVERALL PASS: nothing found" in out and "leakage" not in out and "identifiers" not in out
    with pytest.raises(ConfigError):
        audit.check(spark, TRAIN, report_format="parquet")


# Fields of the documented report.
FIELDS = {
    "report": "generated_at mode config summary unparseable_smiles inconsistent_smiles train_test_leakage internal_duplicates identifier_namespace_issues quality_flags",
    "leakage": "exact identifiers tanimoto_similarity",
    "duplicates": "raw_smiles canonical_smiles inchikey parent_inchikey inchikey_connectivity identifiers",
    "quality": "salt_or_solvate contains_metal multi_component homodimer_without_counterion unclassified_mixture net_charge undefined_stereo suspicious_fragments smiles_whitespace rdkit_warnings mixtures salts_or_metal_complexes",
    "issues": "one_id_multiple_structures one_structure_multiple_ids identifier_whitespace near_duplicates id_with_unparseable_and_valid_structures missing_structure_resolvable_by_id",
    "config": "train_files test_files smiles_column resolved_smiles_columns identifier_columns tautomer_standardisation strip_salts identifier_case_insensitive multi_component_min_heavy_atoms max_train_test_similarity fp_radius fp_n_bits report_format",
}


def test_fields_of_the_report(whole):
    report = whole
    same = lambda found, name: {*found} == {*FIELDS[name].split()}
    assert same(report, "report") and same(report["train_test_leakage"], "leakage") and same(report["identifier_namespace_issues"]["code"], "issues") and same(report["config"], "config")
    assert all(same(report["internal_duplicates"][p], "duplicates") and same(report["quality_flags"][p], "quality") for p in ("train", "test"))
    assert {*report["summary"]["total_quality_flags"]} == {*FIELDS["quality"].split()}
