"""The seven clinical source tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = {
    "condition": "ds_condition_occurrence",
    "procedure": "ds_procedure_occurrence",
    "measurement": "ds_measurement",
    "drug": "ds_drug_exposure",
    "visit": "ds_visit_occurrence",
    "person": "person",
    "concept": "concept",
}


@dataclass(frozen=True)
class ClinicalTables:
    condition: DataFrame
    procedure: DataFrame
    measurement: DataFrame
    drug: DataFrame
    visit: DataFrame
    person: DataFrame
    concept: DataFrame


def read_tables(spark: SparkSession, database: str) -> ClinicalTables:
    """Catalog tables of one database."""
    return ClinicalTables(
        **{field: spark.read.table(f"{database}.{name}") for field, name in TABLE_NAMES.items()}
    )


def read_parquet(spark: SparkSession, path: str) -> ClinicalTables:
    """One parquet folder per table under ``path``."""
    return ClinicalTables(
        **{field: spark.read.parquet(f"{path}/{name}") for field, name in TABLE_NAMES.items()}
    )
