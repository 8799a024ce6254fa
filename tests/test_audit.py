import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import findings, similarity
from sieveline.plans import audit
from sieveline.plans.config import ConfigError, Settings, load, settings_of
from sieveline.sources.tables import SourceError, parse_hub_url, resolve_structure_column


def test_two_pools_from_files(spark, tmp_path):
    (tmp_path / "old.csv").write_text("SMILES,code,lot\nCCCO,A1,L1\nOCCC,A2,L1\nCCCO,A3,L2\nCc1ccccc1,A4,L3\nCCC(=O)O.CCC(=O)O,A5,L4\n[K+].[Br-],A6,L5\nO=CCCC,A7,L6\nCCCl,A8,L7\n")
    (tmp_path / "new.csv").write_text("structure,code\nCCCO,B1\nc1ccccc1C,B2\nCCCC=O,A7\nNCCCC,B4\n")
    out = tmp_path / "report.txt"
    report = audit.audit(spark, str(tmp_path / "old.csv"), str(tmp_path / "new.csv"), identifier_columns=["code", "lot"], report_output=str(out))
    s = report["summary"]
    assert (s["total_train_rows"], s["total_test_rows"], s["total_unparseable"], s["status"]) == (8, 4, 0, "FAIL")
    leak = report["train_test_leakage"]
    # Propanol, toluene and butanal are in both pools; only propanol is written alike.
    assert len(leak["exact"]["inchikey"]) == 3 and len(leak["exact"]["raw_smiles"]) == 1 and s["total_internal_duplicates_train"]["inchikey"] == 1
    assert (s["total_exact_leaked_train_molecules"], s["total_exact_leaked_test_molecules"], s["total_identifier_leakage_events"]) == (5, 3, 1)
    first = leak["exact"]["raw_smiles"][0]
    assert first["value"] == "CCCO" and [o["row_index"] for o in first["train_occurrences"]] == [0, 2] and first["test_occurrences"][0]["pool"] == "test"
    assert [s[f"total_{k}"]["train"] for k in ("mixtures", "salts_or_metal_complexes", "suspicious_fragments")] == [2, 1, 1]
    assert report["config"]["resolved_smiles_columns"]["test"] == {str(tmp_path / "new.csv"): "structure"}
    assert report["internal_duplicates"]["train"]["identifiers"]["lot"][0]["value"] == "L1"
    text = out.read_text()
    assert "OVERALL FAIL" in text and "Train-test leakage: exact matches" in text and "  [FAIL] raw_smiles  value=CCCO" in text and "Quality flags: train" in text
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_counts_by_tier(spark):
    report = audit.audit(spark, pd.DataFrame({"SMILES": ["CCSC", "NCCc1ccccc1", "CCSC", "CCSC"]}), pd.DataFrame({"SMILES": ["OCCCCO", "CCSC"]}))
    assert report["summary"]["blocking"]["by_type"] == {"exact_overlap": {"findings": 1, "rows": 4}}
    assert report["summary"]["flagged"]["by_type"] == {"duplicate_structure": {"findings": 1, "rows": 3}}


def test_maximal_sets_match_brute_force(spark):
    random.seed(5)
    sets = {(t, tuple(sorted(random.sample(range(30), random.randint(1, 5))))) for t in ("x", "y") for _ in range(150)}
    rows = [(t, "test", f"{t}{k}", ("p", "f", i)) for k, (t, s) in enumerate([*sets, *list(sets)[:20]]) for i in s]
    df = spark.createDataFrame(rows, f"finding_type string, pool string, sid string, row {findings.ROW}")
    some = findings.tiered(df.withColumn("finding_type", F.when(F.col("finding_type") == "x", "exact_overlap").otherwise("duplicate_identifier")))
    got = {}
    for r in findings.maximal(some).collect():
        got.setdefault((r["finding_type"][0], r["sid"]), []).append(r["row"]["row_index"])
    assert len(got) == len({(t, tuple(sorted(s))) for (t, _), s in got.items()})
    got = {({"e": "x", "d": "y"}[t], tuple(sorted(s))) for (t, _), s in got.items()}
    assert got == {(t, s) for t, s in sets if not any(t == u and set(s) < set(v) for u, v in sets)}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.7, 1.0])
def test_similar_pairs_match_brute_force(spark, threshold):
    random.seed(6)
    sets = [sorted(random.sample(range(25), random.randint(0, 8))) for _ in range(120)]
    left = spark.createDataFrame([(i, s) for i, s in enumerate(sets[:60])], "a long, bits array<int>")
    right = spark.createDataFrame([(i, s) for i, s in enumerate(sets[60:])], "b long, bits array<int>")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(left, right, threshold).collect()}
    assert got == {(i, j) for i, x in enumerate(sets[:60]) for j, y in enumerate(sets[60:]) if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}


def test_names_and_settings(tmp_path):
    assert resolve_structure_column(["id", "smi", "Structure"], "SMILES", "x") == "smi"
    with pytest.raises(SourceError):
        resolve_structure_column(["smi", "SMI"], "SMILES", "x")
    assert parse_hub_url("https://huggingface.co/datasets/a/b/resolve/main/c/d.csv") == ("a/b", "main", "c/d.csv")
    with pytest.raises(ConfigError):
        Settings(max_train_test_similarity=1.5)
    with pytest.raises(ConfigError):
        settings_of({"fp_radius": 3}, None, check=True)
    (tmp_path / "c.toml").write_text('[paths]\ntrain_files = ["a.csv"]\ntest_files = ["b.csv"]\nreport_output = "r.txt"\n[columns]\nidentifier_columns = ["id"]\n')
    config = load(tmp_path / "c.toml", check=False)
    assert config.settings.report_format == "txt" and config.identifier_columns == ["id"]
    with pytest.raises(ConfigError):
        load(tmp_path / "c.toml", check=True)


def test_strip_is_pythons(spark):
    from sieveline.functions.text import strip
    from sieveline.functions.values import WHITE_SPACE

    assert len(WHITE_SPACE) == 29 and not WHITE_SPACE.strip()
    assert spark.range(1).select(strip(F.lit(f"{WHITE_SPACE}a b{WHITE_SPACE}"))).first()[0] == "a b"


CONFLICTS = [
    (["CCCCNC", "CCCCNC.Cl"], True, "salt_form"),  # an amine and its hydrochloride
    (["CCCCNC", "CCCCNC.Cl"], False, "different_compound"),
    (["CCC(C)N", "CC[C@@H](C)N", "CC[C@H](C)N"], True, "stereo"),  # no centre drawn, and both
    (["CCC(C)N.Cl", "CC[C@@H](C)N"], True, "stereo"),
    (["Oc1ncccn1", "O=c1nccc[nH]1"], True, "tautomer"),  # a proton from oxygen to nitrogen
    (["CCC(=O)CC(C)=O", "CCC(O)=CC(C)=O"], True, "tautomer"),  # keto and enol
    (["CCCc1ccccc1O", "c1ccc2occc2c1"], True, "different_compound"),
]


def test_check_of_one_dataset(spark, tmp_path):
    rows = [(s, f"ID{k}") for k, (some, strip, _) in enumerate(CONFLICTS) for s in some if strip] + [("", "ID0x"), ("CCCCCCCCO", "ID0x"), ("C1CC", "ID0y"), ("CCCCCCCCN", "ID0y"), ("OCCCCCCCC", "Id0-X"), ("CC[N+](C)(C)C", " PAD")]
    (tmp_path / "d.tsv").write_text("smi\tcode\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
    report = audit.check(spark, tmp_path / "d.tsv", identifier_columns=["code", "absent"])
    issues, s = report["identifier_namespace_issues"]["code"], report["summary"]
    kinds = {c["identifier"]: c for c in issues["one_id_multiple_structures"]}
    assert {f"ID{k}": kind for k, (_, strip, kind) in enumerate(CONFLICTS) if strip} == {i: c["conflict_type"] for i, c in kinds.items()}
    assert all(0 < c["max_similarity"] <= 1 for c in kinds.values()) and [len(c["structures"]) for c in kinds.values()].count(3) == 1
    assert kinds["ID0"]["structures"][1]["occurrences"][0] == {"pool": "dataset", "source_file": str(tmp_path / "d.tsv"), "row_index": 1, "raw_smiles": "CCCCNC.Cl"}
    missing, broken = issues["missing_structure_resolvable_by_id"][0], issues["id_with_unparseable_and_valid_structures"][0]
    assert (missing["identifier"], missing["ambiguous"], len(missing["missing"]), missing["candidates"][0]["canonical_smiles"]) == ("ID0x", False, 1, "CCCCCCCCO")
    assert (broken["identifier"], broken["unparseable"][0]["category"]) == ("ID0y", "ring_closure") and broken["unparseable"][0]["error"]
    assert [[x["identifier"] for x in n["identifiers"]] for n in issues["near_duplicates"]] == [["ID0x", "Id0-X"]]
    assert [w["raw_value"] for w in issues["identifier_whitespace"]] == [" PAD"] and issues["identifier_whitespace"][0]["raw_smiles"] == "CC[N+](C)(C)C"
    assert sorted([i["identifier"] for i in x["identifiers"]] for x in issues["one_structure_multiple_ids"]) == [["ID0x", "Id0-X"], ["ID2", "ID3"]]
    forms = [[r["raw_smiles"] for r in f["representations"]] for f in report["inconsistent_smiles"]]
    assert ["CCCCCCCCO", "OCCCCCCCC"] in forms and s["total_inconsistent_smiles"] == len(forms)
    assert s["total_unparseable_by_category"] == {"empty": 1, "ring_closure": 1} and s["total_unparseable_resolvable_via_identifier"] == 1
    assert s["total_identifier_namespace_issues"]["code"]["one_id_multiple_structures_by_type"] == {"different_compound": 1, "salt_form": 1, "stereo": 2, "tautomer": 2}
    assert s["total_quality_flags"]["net_charge"] == 1 and report["quality_flags"]["net_charge"][0]["charge"] == 1 and report["config"]["files"] == [str(tmp_path / "d.tsv")]
    assert "train_test_leakage" not in report and "max_train_test_similarity" not in report["config"] and s["total_rows"] == len(rows)


def test_conflicts_without_salt_stripping(spark):
    for some, strip, kind in CONFLICTS[:2]:
        report = audit.check(spark, pd.DataFrame({"SMILES": some, "id": "X"}), identifier_columns=["id"], strip_salts=strip)
        assert report["identifier_namespace_issues"]["id"]["one_id_multiple_structures"][0]["conflict_type"] == kind


def test_settings_reach_the_kernel(spark, caplog, monkeypatch):
    enol = pd.DataFrame({"SMILES": ["CC(O)=C"]}), pd.DataFrame({"SMILES": ["CC(=O)C"]})
    assert audit.audit(spark, *enol)["summary"]["total_exact_leaked_test_molecules"] == 0
    assert audit.audit(spark, *enol, tautomer_standardisation=True)["summary"]["total_exact_leaked_test_molecules"] == 1
    monkeypatch.setattr(audit, "MANY_PAIRS", 3)
    pools = pd.DataFrame({"SMILES": ["c1ccccc1CCN", "CCCCO"]}), pd.DataFrame({"SMILES": ["c1ccccc1CCO", "CCCCN"]})
    report = audit.audit(spark, *pools, max_train_test_similarity=0.0, fp_n_bits=1000)
    assert report["summary"]["total_tanimoto_leakage_pairs"] == 4 and "pairs" in caplog.text
    assert report["summary"]["blocking"]["by_type"]["tanimoto_similarity"]["findings"] == 4


def test_rows_of_frames_are_numbered_in_order(spark):
    from sieveline.sources.tables import numbered

    df = spark.range(1000).repartition(7, "id").sortWithinPartitions("id")
    rows = numbered(df).collect()
    assert sorted(r["__row_index__"] for r in rows) == list(range(1000))
