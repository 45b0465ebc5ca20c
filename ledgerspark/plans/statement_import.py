"""Path 1, the import job: statements + manual entries + recurring rules -> one deduplicated,
categorized ledger batch (U1, U2, F1), ready for the K1 upsert and the K2/K3 extracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.categorize import categorize
from ledgerspark.operators.dedupe import dedupe_first
from ledgerspark.sources.entries import expand_recurring, manual_entries, recurring_specs
from ledgerspark.sources.statements import load_statements


@dataclass
class ImportResult:
    ledger: DataFrame        # unique rows, first source wins (files by name, manual, recurring)
    quarantine: DataFrame    # bad statement lines
    bad_entries: DataFrame   # bad manual entries
    bad_specs: DataFrame     # bad recurring specs
    unknown_files: DataFrame


def import_all(spark: SparkSession, statements_path=None, manual=None, recurring=None, rules=None,
               as_of=None, bank_keys=None, include_payments: bool = False, strict: bool = False,
               route_on: str = "name") -> ImportResult:
    parts = []
    empty_q = spark.createDataFrame([], "file STRING, pos INT, line STRING, reason STRING")
    quarantine, unknown = empty_q, spark.createDataFrame([], "file STRING")
    if statements_path:
        res = load_statements(spark, statements_path, bank_keys, include_payments, strict, route_on)
        # Files in name order, lines in file order
        parts.append(res.rows.select("date", "description", "merchant", "amount", "category", "provider",
                                     F.lit(0).alias("src_ord"), F.col("file").alias("src_key"),
                                     F.col("pos").cast("bigint").alias("seq")))
        quarantine, unknown = res.quarantine, res.unknown_files
    bad_entries = spark.createDataFrame([], "description STRING, merchant STRING, raw_date STRING, reason STRING")
    if manual is not None:
        good, bad_entries = manual_entries(spark, manual)
        parts.append(good.select("date", "description", "merchant", "amount", "category", "provider",
                                 F.lit(1).alias("src_ord"), F.lit("").alias("src_key"), "seq"))
    bad_specs = spark.createDataFrame([], "spec_id BIGINT, description STRING, merchant STRING, cadence STRING, reason STRING")
    if recurring is not None:
        rows, bad_specs = expand_recurring(recurring_specs(spark, recurring), as_of)
        parts.append(rows.select("date", "description", "merchant", "amount", "category", "provider",
                                 F.lit(2).alias("src_ord"), F.col("spec_id").cast("string").alias("src_key"),
                                 F.col("seq")))
    if not parts:
        raise ValueError("nothing to import")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    unique = dedupe_first(union, order=("src_ord", "src_key", "seq"))
    if rules is not None:
        unique = categorize(unique, rules)
    return ImportResult(unique.select("date", "description", "merchant", "amount", "category", "provider"),
                        quarantine, bad_entries, bad_specs, unknown)
