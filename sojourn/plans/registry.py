"""Every operator as a query over the benchmark tables.

Each query takes ``(spark, sf_dir)`` and reads whole tables. List columns are joined to text and
doubles rounded to nine places, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.functions.seeded import draw_below
from sojourn.operators import (
    augment,
    cohort,
    curate,
    dictionary,
    evaluate,
    export,
    filters,
    prs,
    quantiles,
    score,
    vocab,
)
from sojourn.operators.distribute import numbered
from sojourn.plans import jobs
from sojourn.plans import views as V
from sojourn.session import materialise, new_folder
from sojourn.sources import files, subjects

TARGETS = ("CDzz50003", "CDzz50017")
CUTOFF = 915148800.0  # 1999-01-01
SUBJECT = 42
SUBJECT_WINDOW = 24
SAMPLE = 200
PAD_TO = 128
TAIL = 100
HEAD = 64
BATCH = 16
TASK = cohort.Task(targets=TARGETS, horizon_days=365)
FOLLOWUP = cohort.Task(
    targets=TARGETS, followup_targets=("CDzz50005",), horizon_days=730, stop="first_target"
)
DROPS = S.Augmentation(target_tokens=60, copies=3, max_extra_visits=3)
PRS_DROPS = replace(DROPS, zero_prs_copy=True)
LOGIT_TARGETS = [3, 17, 40]
ITERATIONS = 1000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def nine(c: str, name: str | None = None) -> str:
    return f"round({c}, 9) AS {name or c}"


def listed(c: str) -> str:
    return f"array_join(transform({c}, x -> cast(x as string)), ' ') AS {c}"


def rounded_list(c: str, name: str | None = None) -> str:
    whole = f"transform({c}, x -> cast(cast(round(x * 1e9D, 0) as bigint) as string))"
    return f"array_join({whole}, ' ') AS {name or c}"


# ---- Shared inputs ----


def curated_texts(spark: SparkSession, sf_dir: str, max_tokens: int = S.WINDOW_TOKENS):
    return curate.curated(V.events_view(spark, sf_dir), V.LIMITS, max_tokens)


def encoded_rows(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    _, rows, words = curate.curated_ids(V.events_view(spark, sf_dir), V.LIMITS)
    ids = vocab.special_ids(words)
    return vocab.finished(rows, "flatten(word_ids)", ids, **options).drop("word_ids"), words


# ---- Export ----


@query
def condition_events(spark, sf_dir):
    return export.condition_events(V.clinical_views(spark, sf_dir))


@query
def procedure_events(spark, sf_dir):
    return export.procedure_events(V.clinical_views(spark, sf_dir))


@query
def measurement_events(spark, sf_dir):
    return export.measurement_events(V.clinical_views(spark, sf_dir))


@query
def drug_events(spark, sf_dir):
    return export.drug_events(V.clinical_views(spark, sf_dir))


@query
def visit_events(spark, sf_dir):
    return export.visit_events(V.clinical_views(spark, sf_dir))


@query
def gender_events(spark, sf_dir):
    return export.gender_events(V.clinical_views(spark, sf_dir))


@query
def sex_events(spark, sf_dir):
    return export.sex_events(V.clinical_views(spark, sf_dir))


@query
def race_events(spark, sf_dir):
    return export.race_events(V.clinical_views(spark, sf_dir))


@query
def birth_events(spark, sf_dir):
    return export.birth_events(V.clinical_views(spark, sf_dir))


@query
def all_events(spark, sf_dir):
    return V.events_view(spark, sf_dir)


@query
def sampled_events(spark, sf_dir):
    return export.all_events(V.clinical_views(spark, sf_dir), limit=SAMPLE)


@query
def source_row_counts(spark, sf_dir):
    return export.source_row_counts(V.clinical_views(spark, sf_dir))


@query
def distinct_subjects(spark, sf_dir):
    return export.distinct_subjects(V.clinical_views(spark, sf_dir))


@query
def subject_split(spark, sf_dir):
    return export.split_events(export.distinct_subjects(V.clinical_views(spark, sf_dir)))


@query
def split_events(spark, sf_dir):
    tables = V.clinical_views(spark, sf_dir)
    subjects = export.distinct_subjects(tables)
    return export.split_events(export.all_events(tables), subjects)


@query
def split_sampled_events(spark, sf_dir):
    tables = V.clinical_views(spark, sf_dir)
    return export.split_events(export.all_events(tables, limit=SAMPLE))


@query
def single_subject_events(spark, sf_dir):
    return export.subject_events(V.clinical_views(spark, sf_dir), SUBJECT)


@query
def events_before_cutoff(spark, sf_dir):
    events = export.before_cutoff(V.events_view(spark, sf_dir), CUTOFF)
    dated = export.with_event_date(events)
    return dated.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query
def cutoff_counts(spark, sf_dir):
    return export.cutoff_counts(V.events_view(spark, sf_dir), CUTOFF)


@query
def data_dictionary(spark, sf_dir):
    return dictionary.data_dictionary(V.clinical_views(spark, sf_dir))


@query
def token_names(spark, sf_dir):
    tokens = curated_sequences(spark, sf_dir).selectExpr("explode(split(text, ' ')) AS token")
    return dictionary.token_names(tokens, data_dictionary(spark, sf_dir))


# ---- Filters and curation ----


@query
def rare_code_filter(spark, sf_dir):
    return filters.rare_code_filter(V.events_view(spark, sf_dir), 100)


@query
def subject_activity_filter(spark, sf_dir):
    return filters.subject_activity_filter(V.events_view(spark, sf_dir), 40, 62)


@query
def two_round_filter(spark, sf_dir):
    limits = S.Thresholds(
        min_subjects_per_code=50, min_events_per_subject=40, max_events_per_subject=70
    )
    return filters.frequency_filter(V.events_view(spark, sf_dir), limits)


@query
def code_deciles(spark, sf_dir):
    breaks = quantiles.decile_breaks(V.events_view(spark, sf_dir))
    return breaks.selectExpr("code", "posexplode(breaks) AS (pos, value)").selectExpr(
        "code", "cast(pos + 1 as bigint) AS decile", nine("value")
    )


@query
def tokenised_events(spark, sf_dir):
    return curate.tokenised_events(V.events_view(spark, sf_dir)).selectExpr(
        "subject_id",
        "pos",
        "cast(timestamp as bigint) AS timestamp",
        "date_format(datetime, 'yyyy-MM-dd HH:mm:ss') AS datetime",
        "code",
        "time_token",
        "quantile_token",
        "visit_token",
        "visit_end_token",
        "event_text",
    )


@query
def open_gap_tokens(spark, sf_dir):
    return curate.tokenised_events(V.events_view(spark, sf_dir)).selectExpr(
        "subject_id", "pos", "day_gap", f"{X.open_gap_token('day_gap')} AS open_token"
    )


@query
def sequence_parts(spark, sf_dir):
    return curate.sequence_parts(V.events_view(spark, sf_dir), part_events=50)


@query
def sequence_heads(spark, sf_dir):
    return curate.sequences(V.events_view(spark, sf_dir), max_tokens=HEAD)


@query
def curated_sequences(spark, sf_dir):
    return curated_texts(spark, sf_dir)[1]


# ---- Vocabulary and encoding ----


@query
def vocabulary(spark, sf_dir):
    return vocab.vocabulary(curated_texts(spark, sf_dir)[0])


@query
def encoded_sequences(spark, sf_dir):
    rows, _ = encoded_rows(spark, sf_dir)
    return rows.selectExpr(
        "subject_id", "text", listed("input_ids"), "cast(size(attention_mask) as bigint) AS n_mask"
    )


@query
def padded_sequences(spark, sf_dir):
    rows, _ = encoded_rows(spark, sf_dir, add_eos=True, pad_to=PAD_TO)
    return rows.selectExpr("subject_id", listed("input_ids"), listed("attention_mask"))


@query
def decoded_sequences(spark, sf_dir):
    return vocab.decode(*encoded_rows(spark, sf_dir))


@query
def unknown_tokens(spark, sf_dir):
    # The vocabulary of the filtered events, looked up by the unfiltered sequences.
    words = vocab.vocabulary(rare_code_filter(spark, sf_dir))
    texts = curate.sequence_parts(V.events_view(spark, sf_dir))
    return vocab.unknown_tokens(texts, words)


@query
def last_tokens(spark, sf_dir):
    rows, _ = encoded_rows(spark, sf_dir)
    kept = rows.selectExpr("subject_id", f"{vocab.last_tokens('input_ids', TAIL)} AS input_ids")
    return kept.selectExpr("subject_id", listed("input_ids"))


@query
def training_examples(spark, sf_dir):
    rows, _ = encoded_rows(spark, sf_dir)
    examples = vocab.training_examples(rows, HEAD, shuffle_seed=7)
    return examples.selectExpr("row_id", listed("input_ids"))


@query
def shifted_batches(spark, sf_dir):
    rows, words = encoded_rows(spark, sf_dir)
    examples = vocab.training_examples(rows, TAIL)
    batches = vocab.shifted_batches(examples, BATCH, vocab.special_ids(words)[S.PAD])
    return batches.selectExpr("batch_id", "row_id", listed("input_ids"), listed("labels"))


@query
def causal_batches(spark, sf_dir):
    rows, words = encoded_rows(spark, sf_dir)
    ordered = numbered(rows, "subject_id")
    batches = vocab.causal_batches(ordered, BATCH, vocab.special_ids(words)[S.PAD], "left")
    return batches.selectExpr(
        "batch_id",
        "row_id",
        "subject_id",
        listed("input_ids"),
        listed("attention_mask"),
        listed("labels"),
    )


# ---- Split and augmentation ----


@query
def row_split(spark, sf_dir):
    return augment.split_rows(curated_sequences(spark, sf_dir)).select("subject_id", "split")


@query
def visit_spans(spark, sf_dir):
    rows = curated_sequences(spark, sf_dir).selectExpr("subject_id", "split(text, ' ') AS tokens")
    spans = augment.with_visit_spans(rows).selectExpr("subject_id", "inline(spans)")
    return spans.selectExpr("subject_id", "first AS first_pos", "last AS last_pos")


@query
def visit_dropped_copies(spark, sf_dir):
    return augment.visit_dropped_copies(curated_sequences(spark, sf_dir), DROPS, seed=11)


@query
def zero_prs_copies(spark, sf_dir):
    rows = augment.with_zero_prs_copies(V.prs_view(spark, sf_dir))
    return rows.selectExpr(
        "subject_id", "cast(zeroed as bigint) AS zeroed", rounded_list("flatten(prs)", "prs")
    )


@query
def encoded_texts(spark, sf_dir):
    # Any texts and a vocabulary, without the events that the texts came from.
    kept, texts = curated_texts(spark, sf_dir)
    rows = vocab.encode(texts, materialise(vocab.vocabulary(kept)))
    return rows.selectExpr("subject_id", listed("input_ids"))


def _augmented(spark, sf_dir, settings: S.Augmentation, prs: DataFrame | None = None) -> DataFrame:
    kept, rows, words = curate.curated_ids(V.events_view(spark, sf_dir), V.LIMITS)
    subjects = kept.select("subject_id").distinct()
    return jobs.encoded_dataset(
        rows, vocab.special_ids(words), settings, seed=11, subjects=materialise(subjects), prs=prs
    )


@query
def augmented_dataset(spark, sf_dir):
    encoded = _augmented(spark, sf_dir, DROPS)
    return encoded.selectExpr("subject_id", "split", "copy", "text", listed("input_ids"))


@query
def augmented_prs_dataset(spark, sf_dir):
    encoded = _augmented(spark, sf_dir, PRS_DROPS, V.prs_view(spark, sf_dir))
    return encoded.selectExpr(
        "subject_id",
        "split",
        "copy",
        "cast(zeroed as bigint) AS zeroed",
        "text",
        listed("input_ids"),
        rounded_list("flatten(prs)", "prs"),
    )


@query
def scaled_prs(spark, sf_dir):
    # A small clip, so that clipping shows on values around one.
    made = prs.prepared(V.prs_view(spark, sf_dir), clip=0.1)
    return made.selectExpr("subject_id", rounded_list("features"), "has_prs")


@query
def prs_presence(spark, sf_dir):
    return evaluate.prs_presence(V.prs_view(spark, sf_dir))


# ---- Cohorts ----


@query
def cohort_candidates(spark, sf_dir):
    rows = cohort.candidates(curated_sequences(spark, sf_dir), min_years=5.0)
    return rows.selectExpr("subject_id", "len", "birth_token", nine("time_ehr"))


@query
def cumulative_ages(spark, sf_dir):
    ages = cohort.cumulative_ages(cohort.with_birth(curated_sequences(spark, sf_dir)))
    return ages.selectExpr("subject_id", "pos", "token", nine("age_years"))


@query
def token_years_after(spark, sf_dir):
    rows = cohort.with_birth(curated_sequences(spark, sf_dir))
    at = cohort.token_years_after("tokens", "birth_token", 3)
    return rows.selectExpr("subject_id", f"{at} AS n_year_token")


@query
def first_targets(spark, sf_dir):
    rows = curated_sequences(spark, sf_dir)
    found = cohort.labelled(rows, TASK, stop_before_stopping_time=True)
    return found.select("subject_id", "first_target")


@query
def stopping_points(spark, sf_dir):
    rows = cohort.with_birth(curated_sequences(spark, sf_dir))
    hit = cohort.first_target("tokens", X.text_array(TARGETS))
    stops = [f"{cohort.stopping_point(name, TASK, 'hit')} AS {name}" for name in cohort.STOPS]
    return rows.selectExpr("*", f"{hit} AS hit").selectExpr("subject_id", *stops)


@query
def horizon_labels(spark, sf_dir):
    rows = cohort.with_birth(curated_sequences(spark, sf_dir))
    targets = X.text_array(TARGETS)

    def label(days: int, match: str = "contains") -> str:
        return cohort.horizon_label("tokens", "len div 2", targets, days, match, "gaps")

    return rows.selectExpr(
        "subject_id",
        f"{label(365)} AS label_365",
        f"{label(730)} AS label_730",
        f"{label(730, 'exact')} AS label_exact",
    )


@query
def evaluation_set(spark, sf_dir):
    rows, words = encoded_rows(spark, sf_dir)
    eos = vocab.special_ids(words)[S.EOS]
    out = cohort.evaluation_set(rows, TASK, eos_id=eos, window=250, new_tokens=128)
    return out.selectExpr(
        "subject_id",
        "len",
        "birth_token",
        nine("time_ehr"),
        "first_target",
        "stopping_time",
        "label_token",
        listed("input_ids"),
        "size(attention_mask) AS n_mask",
    )


@query
def followup_evaluation_set(spark, sf_dir):
    out = cohort.evaluation_set(curated_sequences(spark, sf_dir), FOLLOWUP)
    return out.select("subject_id", "first_target", "stopping_time", "label_token")


@query
def task_evaluation_sets(spark, sf_dir):
    kept, rows = curated_texts(spark, sf_dir)
    tasks = V.task_view(spark, sf_dir)
    out = cohort.evaluation_sets(rows, tasks, cohort.Task(), tokens=kept.selectExpr("code AS token"))
    return out.select("subject_id", "task", "first_target", "stopping_time", "label_token")


@query
def seeded_sample(spark, sf_dir):
    return export.seeded_sample(curated_sequences(spark, sf_dir), SAMPLE).select("subject_id")


# ---- One subject ----


def _subject_store(spark, sf_dir) -> subjects.SubjectStore:
    path = new_folder(spark)
    jobs.subject_store_job(V.events_view(spark, sf_dir), path, "v1", V.LIMITS, n_buckets=16)
    return subjects.open_subject_store(spark, path)


@query
def single_subject_sequence(spark, sf_dir):
    made = jobs.single_subject_job(_subject_store(spark, sf_dir), SUBJECT, CUTOFF, SUBJECT_WINDOW)
    return made["sequence"].selectExpr(
        "subject_id", "n_events", "n_tokens", "text", listed("input_ids"), listed("attention_mask")
    )


@query
def single_subject_unknown(spark, sf_dir):
    return jobs.single_subject_job(_subject_store(spark, sf_dir), SUBJECT)["unknown"]


# ---- Prediction scoring ----


@query
def target_mass(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings")
    logits = rows.selectExpr("vec_id", "cast(embedding as array<double>) AS logits")
    return logits.selectExpr("vec_id", nine(score.target_mass("logits", LOGIT_TARGETS), "mass"))


@query
def first_hit_probability(spark, sf_dir):
    steps = V.steps_view(spark, sf_dir)
    bound = score.first_hit_probability(steps, 1000)
    free = score.first_hit_probability(steps, 1000, time_bound=False)
    both = bound.join(free.withColumnRenamed("score", "unbound"), ["subject_id", "seq"])
    return both.selectExpr("subject_id", "seq", nine("score"), nine("unbound"))


@query
def generated_labels(spark, sf_dir):
    texts = score.generated_texts(V.steps_view(spark, sf_dir))
    return score.with_predicted_label(texts, TARGETS, 1000)


def _predictions(spark, sf_dir) -> DataFrame:
    scored = score.scored_sequences(V.steps_view(spark, sf_dir), TARGETS, 1000)
    subjects = cohort.labelled(curated_sequences(spark, sf_dir), TASK).selectExpr(
        "subject_id",
        "array_join(slice(tokens, 1, stopping_time), ' ') AS original_text",
        "label_token",
    )
    return score.prediction_rows(subjects, scored, 4, 32, "steps")


@query
def prediction_rows(spark, sf_dir):
    return _predictions(spark, sf_dir).selectExpr(
        "subject_id",
        "original_text",
        "label_token",
        "array_join(generated_text, '|') AS generated_text",
        listed("pred_labels"),
        nine("probability"),
        rounded_list("probability_scores"),
        "num_predictions",
        "max_new_tokens",
        "model_name",
    )


@query
def scored_predictions(spark, sf_dir):
    # Labels and original texts are read from the texts, so these are not encoded.
    kept, rows = curated_texts(spark, sf_dir)
    words = materialise(vocab.vocabulary(kept))
    size = words.count()
    steps, lists = V.drawn_steps_view(spark, sf_dir, size), V.logits_view(spark, size)
    found = cohort.labelled(rows, TASK)
    out = score.scored_predictions(found, steps, words, TASK, 4, 32, "steps", shared=lists)
    return out.selectExpr(
        "subject_id",
        "label_token",
        "length(original_text) AS n_original",
        "array_join(generated_text, '|') AS generated_text",
        listed("pred_labels"),
        nine("probability"),
        rounded_list("probability_scores"),
    )


@query
def validation_loss(spark, sf_dir):
    rows = V.loss_view(spark, sf_dir).selectExpr("IF(label = -100, double('NaN'), loss) AS loss")
    return score.mean_validation_loss(rows).selectExpr(nine("avg_loss"), "message")


@query
def example_losses(spark, sf_dir):
    rows = score.example_losses(V.loss_view(spark, sf_dir))
    return rows.selectExpr("subject_id", nine("test_loss"))


@query
def subject_losses(spark, sf_dir):
    rows = score.subject_losses(V.loss_view(spark, sf_dir))
    return rows.selectExpr("subject_id", nine("test_loss"))


@query
def overall_loss(spark, sf_dir):
    rows = score.overall_loss(V.loss_view(spark, sf_dir))
    return rows.selectExpr(nine("test_loss"), "n_batches")


# ---- Evaluation ----


def _scored_documents(spark, sf_dir) -> DataFrame:
    """Labelled documents with a score that has many ties."""
    labels = V.table(spark, sf_dir, "labels")
    return labels.join(V.table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", "quality", "lang", "round(n_chars % 997 / 997, 2) AS made_score"
    )


def _subject_predictions(spark, sf_dir) -> DataFrame:
    """Every candidate with four seeded probabilities, and the real horizon label."""
    rows = cohort.with_birth(curated_sequences(spark, sf_dir))
    label = cohort.horizon_label("tokens", "len div 2", X.text_array(TARGETS), 730, gaps="gaps")
    draws = ", ".join(f"{draw_below(101, f'score|{i}', 'subject_id')} / 100" for i in range(4))
    return rows.selectExpr(
        "subject_id",
        "text AS original_text",
        f"{label} AS label_token",
        f"array({draws}) AS probability_scores",
    )


@query
def probability_aggregates(spark, sf_dir):
    rows = _subject_predictions(spark, sf_dir)
    hows = ("mean", "max", "median")
    made = [nine(evaluate.aggregated("probability_scores", how), how) for how in hows]
    return rows.selectExpr("subject_id", *made)


@query
def age_buckets(spark, sf_dir):
    rows = evaluate.prepared(_subject_predictions(spark, sf_dir))
    return rows.selectExpr("subject_id", nine("age"), "age_bucket")


@query
def overall_auc(spark, sf_dir):
    out = evaluate.roc_auc(_scored_documents(spark, sf_dir), "made_score", "quality")
    return out.selectExpr("n_pos", "n_neg", nine("auc"))


@query
def auc_by_language(spark, sf_dir):
    out = evaluate.roc_auc(_scored_documents(spark, sf_dir), "made_score", "quality", ["lang"])
    return out.selectExpr("lang", "n_pos", "n_neg", nine("auc"))


def _rounded(report: DataFrame, *strata: str) -> DataFrame:
    return report.selectExpr(
        *strata, "n", nine("auc"), nine("ci_low"), nine("ci_high"), "n_valid"
    )


@query
def overall_report(spark, sf_dir):
    rows = _scored_documents(spark, sf_dir)
    return _rounded(
        evaluate.report(
            rows, None, ITERATIONS, score="made_score", label="quality", key="doc_id", seed=5
        )
    )


@query
def report_by_age(spark, sf_dir):
    rows = evaluate.prepared(_subject_predictions(spark, sf_dir))
    return _rounded(evaluate.report(rows, "age_bucket", ITERATIONS, seed=5), "age_bucket")


@query
def report_by_prs(spark, sf_dir):
    # Every prediction counts: a subject without scores has none above zero.
    predictions = materialise(_subject_predictions(spark, sf_dir))
    known = V.prs_view(spark, sf_dir)
    scores = predictions.select("subject_id").join(known, "subject_id", "left")
    scores = scores.selectExpr("subject_id", "coalesce(prs, array(array(0.0D))) AS prs")
    rows = evaluate.prepared(predictions, "max", scores)
    return _rounded(evaluate.report(rows, "has_prs", ITERATIONS, seed=5), "has_prs")


# ---- File sources and sinks ----


@query
def event_csv_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_split_events(split_events(spark, sf_dir), path)
    back = [
        files.read_events_csv(spark, f"{path}/split={name}").withColumn("split", F.lit(name))
        for name in ("train", "test")
    ]
    return back[0].unionByName(back[1])


@query
def csv_row_counts(spark, sf_dir):
    path = new_folder(spark)
    files.write_split_events(split_events(spark, sf_dir), path)
    counts = [
        (name, files.count_csv_rows(spark, f"{path}/split={name}")) for name in ("train", "test")
    ]
    return spark.createDataFrame(counts, "split string, n_rows bigint")


@query
def sequence_text_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_sequence_text(curated_sequences(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "text")


@query
def sequence_csv_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_sequence_csv(curated_sequences(spark, sf_dir), path)
    return files.read_sequence_csv(spark, path)


@query
def vocabulary_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_vocabulary(vocabulary(spark, sf_dir), path)
    return files.read_vocabulary(spark, path)


@query
def dataset_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_dataset(augment.split_rows(curated_sequences(spark, sf_dir)), path)
    return files.read_dataset(spark, path, "test").select("subject_id", "text")


@query
def sampled_dataset(spark, sf_dir):
    path = new_folder(spark)
    files.write_dataset(augment.split_rows(curated_sequences(spark, sf_dir)), path)
    return files.read_dataset(spark, path, "all", sample_size=50).select("subject_id", "split")


@query
def evaluation_set_round_trip(spark, sf_dir):
    path = new_folder(spark)
    rows = task_evaluation_sets(spark, sf_dir).withColumn("label_time_range", F.lit(730))
    files.write_evaluation_set(rows, path)
    back = spark.read.parquet(path).where("label_time_range = 730")
    return back.select("subject_id", "task", "stopping_time", "label_token")


@query
def prediction_csv_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_predictions(_predictions(spark, sf_dir), path)
    return files.read_predictions(spark, path).selectExpr(
        "subject_id",
        "label_token",
        "array_join(generated_text, '|') AS generated_text",
        nine(evaluate.aggregated("probability_scores"), "probability_agg"),
        "model_name",
    )


@query
def dictionary_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_dictionary(data_dictionary(spark, sf_dir), path)
    return spark.read.schema("code string, concept_name string").option("header", True).csv(path)


@query
def subject_loss_round_trip(spark, sf_dir):
    path = new_folder(spark)
    files.write_subject_losses(score.subject_losses(V.loss_view(spark, sf_dir)), path)
    back = spark.read.schema("subject_id bigint, test_loss double").option("header", True).csv(path)
    return back.selectExpr("subject_id", nine("test_loss"))
