"""An audit of a train and a test pool, or a check of one dataset, from sources to a report."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import enrich as chem
from ..functions import text
from ..operators import similarity
from ..operators.records import location
from ..sources.shared import materialise
from ..sources.tables import load_pool
from . import report as reports
from .config import FOLDERS, Config, settings_of

LOG = logging.getLogger(__name__)
MANY_PAIRS = 100_000_000


def similar(records: DataFrame, threshold: float, strip_salts: bool) -> DataFrame:
    """Train and test rows with similar fingerprints that no structure key has matched already."""
    key = F.struct("pool", "source_file", "row_index").alias("key")
    rows = records.where("fp is not null").select("row_seq", key, "pool", "fp", "fp_n", text.connectivity(F.col("inchikey")).alias("skeleton"), "parent_inchikey", location().alias("loc"))
    train, test = rows.where("pool = 'train'"), rows.where("pool = 'test'")
    if threshold >= 1.0:  # equal bit sets: an equi-join
        pairs = train.alias("a").join(test.alias("b"), F.col("a.fp") == F.col("b.fp")).select(F.col("a.row_seq").alias("a"), F.col("b.row_seq").alias("b"), F.lit(1.0).alias("similarity"))
    else:
        counts = {r["pool"]: r["count"] for r in rows.groupBy("pool").count().collect()}
        if (asked := counts.get("train", 0) * counts.get("test", 0)) > MANY_PAIRS:
            LOG.warning("%d pairs of train and test rows are to be compared at a similarity of %s; that may be slow", asked, threshold)
        bits = similarity.bits_of(F.col("fp")).alias("bits")
        pairs = similarity.similar_pairs(train.select(F.col("row_seq").alias("a"), bits), test.select(F.col("row_seq").alias("b"), bits), threshold)
        pairs = pairs.select("a", "b", (F.col("common") / F.col("union")).alias("similarity"))
    side = lambda df, x, pool: df.select(F.col("row_seq").alias(x), F.col("key").alias(pool), F.col("skeleton").alias(f"skeleton_{x}"), F.col("parent_inchikey").alias(f"parent_{x}"), F.col("loc").alias(f"l{x}"))
    return similarity.unmatched(pairs, side(train, "a", "train"), side(test, "b", "test"), ["skeleton", "parent"] if strip_salts else ["skeleton"])


def run(spark: SparkSession, config: Config) -> dict:
    pools, ids, resolved, first = [], [], {}, 0
    for name, sources in (("dataset", config.files),) if config.is_check else (("train", config.train), ("test", config.test)):
        rows, seen, columns = load_pool(spark, sources, name, config.smiles_column, config.identifier_columns, first)
        pools.append(rows)
        resolved[name] = columns
        ids += [c for c in seen if c not in ids]
        first += 1 << 60
    rows = pools[0] if len(pools) == 1 else pools[0].unionByName(pools[1])
    s = config.settings
    settings = chem.Settings(s.strip_salts, s.identifier_case_insensitive, s.multi_component_min_heavy_atoms, s.max_train_test_similarity, s.fp_radius, s.fp_n_bits, s.tautomer_standardisation)
    records = materialise(chem.enrich(rows, settings))
    records = materialise(chem.with_tautomer_keys(records, s.strip_salts))
    pairs = None if config.is_check else materialise(similar(records, s.max_train_test_similarity, s.strip_salts))
    columns = [c for c in config.identifier_columns if c in ids]
    if s.report_format in FOLDERS:
        return reports.to_folder(records, config, columns, resolved, pairs)
    made = reports.build(records, config, columns, resolved, pairs)
    if config.report_output:
        reports.save(made, config.report_output, s.report_format)
    return made


def shown(print_report: bool, spark: SparkSession, config: Config) -> dict:
    made = run(spark, config)
    if print_report:
        print(reports.dashboard(made))
    return made


def listed_sources(x) -> list:
    return list(x) if isinstance(x, list | tuple) else [x]


def audit(spark: SparkSession, train, test, smiles_column: str = "SMILES", identifier_columns: list[str] | None = None, report_output: str | None = None, print_report: bool = True, **settings) -> dict:
    """Audits a train pool against a test pool; sources are paths, URLs, pandas or Spark frames, one or a list."""
    return shown(print_report, spark, Config(listed_sources(train), listed_sources(test), [], smiles_column, list(identifier_columns or []), settings_of(settings, report_output, False), report_output))


def check(spark: SparkSession, data, smiles_column: str = "SMILES", identifier_columns: list[str] | None = None, report_output: str | None = None, print_report: bool = True, **settings) -> dict:
    """Checks one dataset."""
    return shown(print_report, spark, Config([], [], listed_sources(data), smiles_column, list(identifier_columns or []), settings_of(settings, report_output, True), report_output))
