"""The batch jobs: export, curate, evaluation sets, scores of what was generated, reports, one subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.operators import augment, cohort, curate, evaluate, export, filters, quantiles, score, vocab
from sojourn.session import materialise, stored
from sojourn.sources import files, subjects
from sojourn.sources.clinical import ClinicalTables
from sojourn.sources.guard import CLOSED, Egress


def export_job(tables: ClinicalTables, path: str, form: str = "parquet", egress: Egress = CLOSED) -> None:
    """All events, split by subject, to ``path/split=train|test``."""
    egress.admit(path)
    events = export.split_events(export.all_events(tables), export.distinct_subjects(tables))
    files.write_split_events(events, path, form, egress=egress)


def encoded_dataset(
    rows: DataFrame,
    specials: dict[str, int],
    settings: S.Augmentation = S.Augmentation(),
    seed=0,
    subjects: DataFrame | None = None,
    prs: DataFrame | None = None,
) -> DataFrame:
    """Sequences with ``word_ids`` split, the training part augmented, ids neither cut nor padded.

    One pass over the rows: texts and ids are cut together. ``subjects`` are those of the rows. With
    ``prs`` (``subject_id, prs``, one row per subject) every row gets its subject's scores, null
    without any, and ``settings.zero_prs_copy`` adds the copies without scores.
    """
    if settings.zero_prs_copy and prs is None:
        raise ValueError("copies with zeroed scores need the PRS rows")
    split = augment.split_rows(rows, subjects=subjects)
    if prs is not None:
        split = split.join(prs.select("subject_id", "prs"), "subject_id", "left")
    made = augment.augmented(split, settings, seed)
    return vocab.finished(made, "flatten(word_ids)", specials).drop("word_ids")


def curation_job(
    events: DataFrame,
    path: str,
    limits: S.Thresholds | None = S.Thresholds(),
    max_tokens: int = S.WINDOW_TOKENS,
    settings: S.Augmentation = S.Augmentation(),
    egress: Egress = CLOSED,
    prs: DataFrame | None = None,
) -> None:
    """Sequences (text, CSV, unsplit dataset), vocabulary and encoded dataset under ``path``.

    Code rarity and deciles are taken over all events at once. An empty result is an error. The
    encoded dataset carries ``prs`` where given.
    """
    egress.admit(path)
    _, rows, words = curate.curated_ids(events, limits, max_tokens)
    rows = stored(rows)
    texts = rows.drop("word_ids")
    if texts.isEmpty():
        raise ValueError("no sequences were generated; try lower filter thresholds")
    files.write_sequence_text(texts, f"{path}/sequences_text", egress=egress)
    files.write_sequence_csv(texts, f"{path}/sequences_csv", egress=egress)
    files.write_vocabulary(words, f"{path}/vocabulary", egress=egress)
    files.write_dataset(texts, f"{path}/dataset_unsplit", (), egress=egress)
    dataset = encoded_dataset(rows, vocab.special_ids(words), settings, prs=prs)
    files.write_dataset(dataset, f"{path}/dataset", ("split",), egress=egress)


def evaluation_set_job(
    dataset: DataFrame, task_codes: DataFrame, path: str, task: cohort.Task, egress: Egress = CLOSED
) -> None:
    """Evaluation rows of every task, partitioned by task and horizon."""
    egress.admit(path)
    rows = cohort.evaluation_sets(dataset, task_codes, task)
    rows = rows.withColumn("label_time_range", F.lit(task.horizon_days))
    files.write_evaluation_set(rows, path, egress=egress)


def scoring_job(
    evaluation: DataFrame,
    steps: DataFrame,
    words: DataFrame,
    path: str,
    task: cohort.Task,
    num_predictions: int,
    max_new_tokens: int,
    model_name: str,
    losses: DataFrame | None = None,
    time_bound: bool = True,
    egress: Egress = CLOSED,
) -> DataFrame | None:
    """The predictions file of one task's evaluation set, as :func:`score.scored_predictions`.

    With ``losses`` (a column ``loss`` per batch) returns their mean, or why there is none.
    """
    egress.admit(path)
    made = score.scored_predictions(
        evaluation, steps, words, task, num_predictions, max_new_tokens, model_name, time_bound
    )
    files.write_predictions(made, path, egress=egress)
    return None if losses is None else score.mean_validation_loss(losses)


def evaluation_job(
    predictions: DataFrame,
    prs: DataFrame | None = None,
    how: str = "mean",
    by_age: bool = False,
    by_prs: bool = False,
    iterations: int = 1000,
) -> dict[str, DataFrame]:
    """Overall, and optionally per age bucket and per PRS presence, AUC with interval."""
    if by_prs and prs is None:
        raise ValueError("strata by PRS need the PRS rows")
    rows = materialise(evaluate.prepared(predictions, how, prs))
    out = {"overall": evaluate.report(rows, None, iterations)}
    if by_age:
        out["age"] = evaluate.report(rows, "age_bucket", iterations).orderBy("age_bucket")
    if by_prs:
        out["prs"] = evaluate.report(rows, "has_prs", iterations).orderBy("has_prs")
    return out


def subject_store_job(
    events: DataFrame,
    path: str,
    version: str,
    limits: S.Thresholds | None = S.Thresholds(),
    n_buckets: int = subjects.BUCKETS,
    egress: Egress = CLOSED,
) -> None:
    """A version of the subject store: all events, deciles and vocabulary of those that curation keeps."""
    egress.admit(path)
    kept = stored(events if limits is None else filters.frequency_filter(events, limits))
    breaks, words = quantiles.decile_breaks(kept), vocab.vocabulary(kept)
    subjects.write_subject_store(events, breaks, words, path, version, n_buckets, egress)


def single_subject_job(
    store: subjects.SubjectStore,
    subject_id: int,
    cutoff: float | None = None,
    window: int = S.WINDOW_TOKENS,
) -> dict[str, DataFrame]:
    """A model's input for one subject, with the deciles and the vocabulary of the store's version.

    ``sequence`` is a row ``subject_id, n_events, n_tokens, text, input_ids, attention_mask``: how long
    the whole sequence is, its last ``window`` tokens and their last ``window`` ids. ``unknown`` has
    ``token, n`` of all its tokens that the vocabulary lacks. ``cutoff`` keeps undated events and those
    before it. Without events both are empty.

    Every event yields a token, so the last ``window`` events hold all of the tail; only they are
    collected, however many events the subject has.
    """
    if window < 1:
        raise ValueError(f"a window has at least one token, not {window}")
    events = store.events_of(subject_id)
    if cutoff is not None:
        events = export.before_cutoff(events, cutoff)
    texts = curate.tokenised_events(events, store.breaks)
    texts = materialise(texts.select("subject_id", "pos", "event_text"))
    n_tokens = "sum(size(split(event_text, ' '))) AS n_tokens"
    sizes = texts.groupBy("subject_id").agg(F.expr("count(*) AS n_events"), F.expr(n_tokens))
    n_events = texts.count()
    listed = "sort_array(collect_list(struct(pos, event_text)))"
    whole = f"array_join(transform({listed}, e -> e.event_text), ' ') AS text"
    tail = texts.where(f"pos > {n_events - window}").groupBy("subject_id").agg(F.expr(whole))
    tail = tail.withColumn("text", F.expr(f"substring_index(text, ' ', -{window})"))
    # Tail and sizes are one row each.
    row = vocab.encode(tail.join(sizes, "subject_id"), store.words)
    ids = vocab.last_tokens("input_ids", window)
    row = row.selectExpr(
        "subject_id",
        "n_events",
        "n_tokens",
        "text",
        f"{ids} AS input_ids",
        f"array_repeat(1, size({ids})) AS attention_mask",
    )
    unknown = vocab.unknown_tokens(texts, store.words, text="event_text")
    return {"sequence": row, "unknown": unknown.select("token", "n")}
