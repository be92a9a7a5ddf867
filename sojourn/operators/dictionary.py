"""Code dictionary and name lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.operators.distribute import lookup_join
from sojourn.operators.export import exported_visits, prefixed
from sojourn.sources.clinical import ClinicalTables


def data_dictionary(t: ClinicalTables) -> DataFrame:
    """``code, concept_name`` of every exported code. Person concepts get their name, if any,
    from the concept table."""
    named = [
        (t.condition, S.CONDITION, "condition_concept_id"),
        (t.procedure, S.PROCEDURE, "procedure_concept_id"),
        (t.measurement, S.MEASUREMENT, "measurement_concept_id"),
        (t.drug, S.DRUG, "drug_concept_id"),
        (exported_visits(t), S.VISIT, "visit_concept_id"),
    ]
    parts = [
        df.select(concept, "standard_concept_name")
        .distinct()
        .selectExpr(f"{prefixed(prefix, concept)} AS code", "standard_concept_name AS concept_name")
        for df, prefix, concept in named
    ]
    person_concepts = [
        t.person.selectExpr(f"'{prefix}' AS prefix", f"cast({concept} as bigint) AS concept_id")
        .distinct()
        for prefix, concept in [
            (S.GENDER, "gender_concept_id"),
            (S.SEX, "sex_at_birth_concept_id"),
            (S.RACE, "race_concept_id"),
        ]
    ]
    wanted = reduce(DataFrame.union, person_concepts)
    # The concept table is large and the wanted ids are few: keep only those before joining.
    concepts = t.concept.selectExpr("cast(concept_id as bigint) AS concept_id", "concept_name")
    found = lookup_join(concepts, wanted.select("concept_id").distinct(), "concept_id", "left_semi")
    parts.append(
        wanted.join(found, "concept_id", "left").selectExpr(
            "concat(prefix, cast(concept_id as string)) AS code", "concept_name"
        )
    )
    birth = t.person.sparkSession.sql(
        f"SELECT '{S.BIRTH_CODE}' AS code, 'Birth date' AS concept_name"
    )
    return reduce(DataFrame.union, [*parts, birth])


def token_names(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Category, visit label and concept name of each distinct ``token``.

    Names are looked up only for tokens with a code prefix; the greatest name wins where a code
    has several.
    """
    names = dictionary.groupBy(F.col("code").alias("token")).agg(
        F.expr("max(concept_name) AS concept_name")
    )
    labelled = (
        tokens.select("token")
        .distinct()
        .selectExpr(
            "token",
            f"{X.code_category('token')} AS category",
            f"{X.visit_label('token')} AS visit_label",
        )
    )
    name = "IF(category IS NULL, NULL, coalesce(concept_name, '(not in dictionary)'))"
    return lookup_join(labelled, names, "token", "left").selectExpr(
        "token", "category", "visit_label", f"{name} AS concept_name"
    )
