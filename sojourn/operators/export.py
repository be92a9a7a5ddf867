"""Clinical tables to one event stream, and the subject-level split of that stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.operators.distribute import digest_cutoff, drawn_within
from sojourn.sources.clinical import ClinicalTables


def epoch(ts: str) -> str:
    """Whole seconds since 1970 UTC, for zoned and zoneless timestamps."""
    return f"cast(unix_seconds(cast({ts} as timestamp)) as double)"


def event_rows(
    table: DataFrame,
    code: str,
    time: str | None = None,
    value: str | None = None,
    in_visit: bool = False,
) -> DataFrame:
    """Project a clinical table on the event schema. Empty visit names count as unknown."""
    visit_id = "visit_occurrence_id" if in_visit else "NULL"
    visit_type = "nullif(visit_occurrence_concept_name, '')" if in_visit else "NULL"
    return table.selectExpr(
        "cast(person_id as bigint) AS subject_id",
        f"{epoch(time) if time else 'cast(NULL as double)'} AS time",
        f"{code} AS code",
        f"cast({value or 'NULL'} as double) AS numeric_value",
        f"cast({visit_id} as bigint) AS visit_id",
        f"cast({visit_type} as string) AS visit_type",
    )


def prefixed(prefix: str, concept: str) -> str:
    return f"concat('{prefix}', cast({concept} as string))"


def condition_events(t: ClinicalTables) -> DataFrame:
    code = prefixed(S.CONDITION, "condition_concept_id")
    return event_rows(t.condition, code, "condition_start_datetime", in_visit=True)


def procedure_events(t: ClinicalTables) -> DataFrame:
    code = prefixed(S.PROCEDURE, "procedure_concept_id")
    return event_rows(t.procedure, code, "procedure_datetime", in_visit=True)


def measurement_events(t: ClinicalTables) -> DataFrame:
    code = prefixed(S.MEASUREMENT, "measurement_concept_id")
    return event_rows(t.measurement, code, "measurement_datetime", "value_as_number", True)


def drug_events(t: ClinicalTables) -> DataFrame:
    code = prefixed(S.DRUG, "drug_concept_id")
    return event_rows(t.drug, code, "drug_exposure_start_datetime", "quantity", True)


def exported_visits(t: ClinicalTables) -> DataFrame:
    names = ", ".join(f"'{n}'" for n in S.EXPORTED_VISITS)
    return t.visit.where(f"standard_concept_name IN ({names})")


def visit_events(t: ClinicalTables) -> DataFrame:
    code = prefixed(S.VISIT, "visit_concept_id")
    return event_rows(exported_visits(t), code, "visit_start_datetime")


def gender_events(t: ClinicalTables) -> DataFrame:
    return event_rows(t.person, prefixed(S.GENDER, "gender_concept_id"))


def sex_events(t: ClinicalTables) -> DataFrame:
    return event_rows(t.person, prefixed(S.SEX, "sex_at_birth_concept_id"))


def race_events(t: ClinicalTables) -> DataFrame:
    return event_rows(t.person, prefixed(S.RACE, "race_concept_id"))


def birth_events(t: ClinicalTables) -> DataFrame:
    return event_rows(t.person, f"'{S.BIRTH_CODE}'", "birth_datetime")


BRANCHES = {
    "condition": condition_events,
    "procedure": procedure_events,
    "measurement": measurement_events,
    "drug": drug_events,
    "visit": visit_events,
    "gender": gender_events,
    "sex": sex_events,
    "race": race_events,
    "birth": birth_events,
}


def all_events(t: ClinicalTables, limit: int | None = None) -> DataFrame:
    """Bag union of the nine branches.

    ``limit`` takes a sample of that many rows per branch: the first in event order, so that the
    sample is the same on every run.
    """
    parts = [branch(t) for branch in BRANCHES.values()]
    if limit is not None:
        parts = [p.orderBy("subject_id", *S.EVENT_ORDER).limit(limit) for p in parts]
    return reduce(DataFrame.union, parts)


def subject_events(t: ClinicalTables, subject_id: int) -> DataFrame:
    """One subject's events; the predicate reaches each branch's scan."""
    return all_events(t).where(f"subject_id = {subject_id}")


def before_cutoff(events: DataFrame, cutoff: float) -> DataFrame:
    """Undated events and those strictly before ``cutoff`` epoch seconds."""
    return events.where(f"time IS NULL OR time < {cutoff}")


def cutoff_counts(events: DataFrame, cutoff: float) -> DataFrame:
    kept = f"count_if(time IS NULL OR time < {cutoff})"
    return events.selectExpr(
        "count(*) AS n_before", f"{kept} AS n_after", f"count(*) - {kept} AS n_removed"
    )


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("date", F.expr("to_date(timestamp_seconds(time))"))


def source_row_counts(t: ClinicalTables) -> DataFrame:
    """Rows per source and in total. People count three times, once per demographic."""
    sources = {
        "condition": (t.condition, 1),
        "procedure": (t.procedure, 1),
        "measurement": (t.measurement, 1),
        "drug": (t.drug, 1),
        "visit": (exported_visits(t), 1),
        "demographics": (t.person, 3),
    }
    parts = [
        df.selectExpr(f"'{name}' AS source", f"count(*) * {times} AS n_row")
        for name, (df, times) in sources.items()
    ]
    return (
        reduce(DataFrame.union, parts)
        .rollup("source")
        .agg(F.expr("sum(n_row) AS n_row"))
        .selectExpr("coalesce(source, 'total') AS source", "n_row")
    )


def distinct_subjects(t: ClinicalTables) -> DataFrame:
    return t.person.selectExpr("cast(person_id as bigint) AS subject_id").distinct()


def split_cutoff(subjects: DataFrame, test_fraction: float, seed) -> str | None:
    """Cutoff that puts exactly ``int((1 - test_fraction) * n)`` distinct subjects in train."""
    keep = int((1 - test_fraction) * subjects.count())
    return digest_cutoff(subjects, "subject_id", seed, keep)


def with_split(df: DataFrame, cutoff: str | None, seed) -> DataFrame:
    """Route rows by their subject's digest; whatever is not train is test."""
    is_train = drawn_within(cutoff, seed, "subject_id")
    return df.withColumn("split", F.expr(f"IF({is_train}, 'train', 'test')"))


def split_events(
    events: DataFrame,
    subjects: DataFrame | None = None,
    test_fraction: float = S.TEST_FRACTION,
    seed=S.SPLIT_SEED,
) -> DataFrame:
    """Subject-level train/test column. Without ``subjects`` the events' own are split."""
    if subjects is None:
        subjects = events.select("subject_id").distinct()
    return with_split(events, split_cutoff(subjects, test_fraction, seed), seed)


def seeded_sample(df: DataFrame, n: int, key: str = "subject_id", seed=42) -> DataFrame:
    """Exactly ``n`` rows by seeded order of a unique key, or all rows if there are fewer."""
    cutoff = digest_cutoff(df.select(key), key, seed, n)
    return df.where(drawn_within(cutoff, seed, key))
