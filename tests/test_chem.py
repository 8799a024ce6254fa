import itertools
import random

import pytest
from pyspark.sql import functions as F

from sieveline.chem import molecule as M
from sieveline.chem.enrich import enrich
from sieveline.functions import values as V
from sieveline.operators import checks
from sieveline.plans import molecules
from sieveline.sources.shared import materialise

IBUPROFEN, NICOTINE = "CC(C)Cc1ccc(C(C)C(=O)O)cc1", "CN1CCC[C@H]1c1cccnc1"


@pytest.mark.parametrize(("smiles", "said"), [
    ("C1CC", "unclosed ring"), ("CN(C)(C)(C)C", "valence"), ("C" * 255 + "(", "open parentheses"), ("CC(C", "extra open parentheses"), ("CC[R]", "syntax error"), ("CCO.[0.5H2O]", "syntax error"), ("c1cccc1", "kekulize"),
])
def test_errors(smiles, said):
    with pytest.raises(M.SmilesError, match=said):
        M.parse(smiles)


@pytest.mark.parametrize(("smiles", "counts"), [
    ("CC(N)C(=O)O", (1, 0)), ("C[C@H](N)C(=O)O", (0, 0)), ("CC=CC", (0, 1)), ("C/C=C/C", (0, 0)), ("CC1CCC(C)CC1", (2, 0)), ("CS(=O)CC", (1, 0)), ("CCO", (0, 0)),
])
def test_undefined_stereo(smiles, counts):
    assert M.undefined_stereo(M.parse(smiles)) == counts


def test_equal_structures():
    for a, b in [("OCC", "CCO"), ("C1=CC=CC=C1", "c1ccccc1"), ("N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O"), ("C(/C)=C/C", "C/C=C\\C")]:
        x, y = M.parse(a), M.parse(b)
        assert (M.write(x), M.structure_key(x)) == (M.write(y), M.structure_key(y))
    for a, b in [("C[C@@H](N)C(=O)O", "C[C@H](N)C(=O)O"), ("C/C=C/C", "C/C=C\\C")]:
        x, y = (M.structure_key(M.parse(s)) for s in (a, b))
        assert x != y and x[:14] == y[:14]
    assert M.structure_key(M.parse("Oc1ccccn1")) == M.structure_key(M.parse("O=c1cccc[nH]1"))
    assert M.fingerprint(M.parse("CCCCCCCC")) == M.fingerprint(M.parse("CCCCCCCCC"))


def test_canonical_form_does_not_depend_on_atom_order():
    random.seed(3)
    for smiles in [*V.COUNTERIONS, *V.SOLVENTS, *V.SMALL_MOLECULES, IBUPROFEN, "c1ccc2ccccc2c1", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C"]:
        mol = M.parse(smiles)
        want = (M.write(mol), M.structure_key(mol), M.fingerprint(mol))
        assert M.write(M.parse(want[0])) == want[0]
        for _ in range(3):
            order = list(range(len(mol.atoms)))
            random.shuffle(order)
            new = mol.part(order)
            M.perceive(new)
            assert (M.write(new), M.structure_key(new), M.fingerprint(new)) == want


def test_mixtures_and_errors(spark):
    rows = [
        (f"{IBUPROFEN}.{NICOTINE}", {"is_multi_component"}), ("CCN.CCN", {"is_homodimer_without_counterion"}), ("CCN(CC)CC.CCN(CC)CC.OS(=O)(=O)O", {"is_salt_or_solvate"}), ("c1ccccc1CCN.Cl", {"is_salt_or_solvate"}),
        ("c1ccccc1CCN.C1CC1", {"is_unclassified_mixture"}), ("Cl.O", {"is_unclassified_mixture"}), ("CC(=O)[O-].[Na+]", {"is_unclassified_mixture", "contains_metal"}), ("C[Hg]Cl", {"contains_metal"}), (IBUPROFEN, set()),
        ("CC\nO", "control_characters"), ("", "empty"), (None, "empty"), ("NA", "placeholder"), ("[Gramicidin]", "placeholder"), ("CCR1", "markush"), ("CCO.[0.5H2O]", "stoichiometry_text"), ("c1cccc1", "kekulisation"), ("C1CC", "ring_closure"), ("C" * 255 + "(", "truncated"),
    ]
    pool = spark.createDataFrame([(i, "train", "a", i, s, {"id": " x "}) for i, (s, _) in enumerate(rows)], "row_seq long, pool string, source_file string, row_index long, raw_smiles string, raw_identifiers map<string,string>")
    flags = ["contains_metal", "is_salt_or_solvate", "is_multi_component", "is_homodimer_without_counterion", "is_unclassified_mixture"]
    for r, (_, want) in zip(enrich(pool).orderBy("row_seq").collect(), rows, strict=True):
        assert r["parse_error_category"] == want if isinstance(want, str) else ({f for f in flags if r[f]} == want and r["parse_error"] is None), r["raw_smiles"]
        assert r["identifiers"] == {"id": "x"}


def test_matching_on_odd_cycles():
    for n in (4, 5, 6, 7):
        ring = {i: [(i - 1) % n, (i + 1) % n] for i in range(n)}
        assert (M.matching(set(ring), ring) is not None) == (n % 2 == 0)
    near = {i: [j for j in range(6) if j != i] for i in range(6)}
    pairs = M.matching(set(near), near)
    assert sorted(itertools.chain(*{tuple(sorted(p)) for p in pairs.items()})) == list(range(6))


def pool_of_one_partition(spark):
    """400 rows of 7 strings, some of them unreadable, in one partition."""
    strings = ["CCO", "OCC", "CCN.Cl", "", "CC\nO", "C1CC", "C[C@H](N)C(=O)O"]
    rows = spark.range(0, 400, 1, 1)
    return rows.select(
        F.col("id").alias("row_seq"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("pool"), F.lit("a").alias("source_file"), F.col("id").alias("row_index"),
        F.element_at(F.array(*map(F.lit, strings)), (F.col("id") % 7 + 1).cast("int")).alias("raw_smiles"), F.create_map(F.lit("id"), F.concat(F.lit(" x"), F.col("id") % 3)).alias("raw_identifiers"))


def test_rows_of_one_partition_are_dealt_and_strings_described_once(spark):
    rows = enrich(pool_of_one_partition(spark))
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = rows.groupBy("raw_smiles", "parse_error_category", "is_salt_or_solvate").agg(F.count("*").alias("n"), F.count("fp").alias("fps"), F.count_distinct("inchikey").alias("keys")).collect()
    assert {r["raw_smiles"]: (r["parse_error_category"], r["is_salt_or_solvate"], r["n"], r["fps"], r["keys"]) for r in found} == {
        "CCO": (None, False, 58, 58, 1), "OCC": (None, False, 57, 57, 1), "CCN.Cl": (None, True, 57, 57, 1), "": ("empty", False, 57, 0, 0),
        "CC\nO": ("control_characters", False, 57, 0, 0), "C1CC": ("ring_closure", False, 57, 0, 0), "C[C@H](N)C(=O)O": (None, False, 57, 57, 1)}
    assert len(found) == 7


def test_leaked_rows_join_a_table_of_known_size(spark):
    rows = materialise(enrich(pool_of_one_partition(spark)))
    found = checks.leaked_rows(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1  # no overlaps of unknown size
    leaked = {(r["row_index"], r["kind"]) for r in found.collect()}
    assert leaked == {(i, "exact") for i in range(400) if i % 7 != 3}


def test_tautomers_are_searched_only_where_they_are_looked_at(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(molecules.chem, "with_tautomer_keys", refused)
    found = molecules.QUERIES["nested_identifier_overlaps"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["id_column", "value", "train_rows", "test_rows"]
    with pytest.raises(AssertionError, match="searched"):
        molecules.QUERIES["nested_conflicts"](spark, "/root/testdata/sf0.001")


def test_first_rows_of_equal_structures_come_by_one_join(spark):
    rows = materialise(enrich(pool_of_one_partition(spark)).withColumn("parent_inchikey", F.when(F.col("raw_smiles") != "OCC", F.col("parent_inchikey"))))
    found = molecules.molecule_properties(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    same = {r["row_index"]: (r["same_structure"], r["same_canonical"], r["same_parent"], r["same_skeleton"], r["same_compound"]) for r in found.collect()}
    ethanol, none = (0, 0, 0, 0, 0), (None,) * 5
    want = [ethanol, (0, 0, None, 0, 0), (2,) * 5, none, none, none, (6,) * 5]
    assert same == {i: want[i % 7] for i in range(400)}
