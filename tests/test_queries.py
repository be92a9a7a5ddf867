"""Registered queries against DuckDB at the smallest scale; ``check.py`` runs them all."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from sojourn.operators import export
from sojourn.plans import oracle, registry
from sojourn.plans import views as V

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "all_events",
    "source_row_counts",
    "data_dictionary",
    "subject_split",
    "code_deciles",
    "tokenised_events",
    "curated_sequences",
    "visit_dropped_copies",
    "task_evaluation_sets",
    "first_hit_probability",
    "overall_report",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    sql = entry.oracle_sql()[name]
    verdict = check.compare(spark, con, SF_DIR, name, entry.queries()[name], sql)
    assert verdict.startswith("ok"), verdict


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.statements())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_subject_predicate_reaches_every_scan(spark):
    one = export.subject_events(V.clinical_views(spark, SF_DIR), 42)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]") == 4
    assert plan.count("EqualTo(o_custkey,42)") == 4
    assert plan.count("EqualTo(user_id,42)") == 1


def test_lists_are_collected_as_rows_lie(spark):
    for name in ("curated_sequences", "decoded_sequences"):
        made = entry.queries()[name](spark, SF_DIR)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "SortAggregate" in plan
        assert plan.count(" Sort [") == 1  # that of the windows


def test_logits_are_listed_once_per_remainder(spark):
    steps = V.logit_steps_view(spark, SF_DIR, 30)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    # The lists lie on the side of the remainders, after the events in the text.
    assert plan.index("parquet") < plan.rindex("transform(") and plan.count("transform(") == 1
    rows = steps.join(V.table(spark, SF_DIR, "events"), F.expr(
        "subject_id = event_id div 128 AND seq = event_id div 32 % 4 AND step = event_id % 32"
    ))
    cents = "cast(round(value * 100) as bigint)"
    plain = f"transform(sequence(0, 29), i -> ({cents} * (i + 3L)) % 997L / 100.0D)"
    assert rows.count() == steps.count() == V.table(spark, SF_DIR, "events").count()
    assert rows.where(f"NOT logits <=> {plain}").count() == 0


def test_scoring_encodes_no_texts(spark, con):
    name = "scored_predictions"
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "word_ids" not in plan
    verdict = check.compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_scoring_moves_no_logits_and_joins_texts_once(spark):
    made = entry.queries()["scored_predictions"](spark, SF_DIR)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "logits#" not in plan and "logits_id#" in plan
    # A text is neither joined again for the filter on it nor split again for the original text.
    assert plan.count("transform(_listed") == 1 and plan.count("split(") == 1


@pytest.mark.parametrize(
    "name", ["decoded_sequences", "visit_spans", "subject_activity_filter", "rare_code_filter"]
)
def test_reworked_query_equals_sql(spark, con, name):
    sql = entry.oracle_sql()[name]
    verdict = check.compare(spark, con, SF_DIR, name, entry.queries()[name], sql)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id", "text"] and df.count() > 0
