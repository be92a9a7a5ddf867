"""Scores of generated sequences and losses.

Inputs are tables that a model wrote: one row per generated token (``subject_id, seq, step, token,
p``) and one row per evaluated token loss. A generated sequence has at most as many steps as the
model was allowed to generate, so windows over one sequence are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.operators.cohort import Task, has_target, horizon_label
from sojourn.operators.distribute import lookup_join
from sojourn.operators.vocab import IS_SPECIAL

LABEL_USED = f"label <> {S.IGNORED_LABEL}"


def target_mass(logits: str, target_ids: Sequence[int]) -> str:
    """Softmax mass of the target ids (SQL); ids outside the vocabulary add nothing.

    The largest logit is bound to a variable: named inside the sum it would be sought per element.
    """
    total = f"aggregate({logits}, 0.0D, (a, x) -> a + exp(x - top))"
    hit = " + ".join(f"coalesce(exp(get({logits}, {i}) - top), 0.0D)" for i in target_ids)
    return f"transform(array(array_max({logits})), top -> ({hit}) / {total})[0]"


def first_hit_probability(
    steps: DataFrame, horizon_days: int, time_bound: bool = True
) -> DataFrame:
    """``subject_id, seq, score``: probability that some step emits a target in time.

    Steps count up to and including the one whose gap passes the horizon. With ``p`` per step the
    chance of no hit is the product of ``1 - p``, taken in logarithms; a certain step makes it 0.
    ``time_bound=False`` counts every step.
    """
    if time_bound:
        days = f"coalesce({X.gap_days('token')}, 0)"
        upto = f"sum({days}) OVER (PARTITION BY subject_id, seq ORDER BY step)"
        steps = steps.selectExpr("*", f"{upto} - {days} AS earlier")
        steps = steps.where(f"earlier <= {horizon_days}")
    miss = "exp(coalesce(sum(IF(p < 1, log1p(-p), NULL)), 0.0D))"
    score = f"IF(max(p) >= 1, 1.0D, 1 - {miss}) AS score"
    return steps.groupBy("subject_id", "seq").agg(F.expr(score))


def generated_texts(steps: DataFrame) -> DataFrame:
    """``subject_id, seq, generated_text``: a sequence's tokens in step order, specials skipped."""
    listed = f"sort_array(collect_list(IF({IS_SPECIAL}, NULL, struct(step, token))))"
    return steps.groupBy("subject_id", "seq").agg(
        F.expr(f"array_join(transform({listed}, s -> s.token), ' ') AS generated_text")
    )


def with_predicted_label(
    texts: DataFrame, targets: Sequence[str], horizon_days: int, match: str = "contains"
) -> DataFrame:
    """``pred_label``: the horizon label of the generated text from its start."""
    label = horizon_label(
        "split(generated_text, ' ')", 0, X.text_array(targets), horizon_days, match
    )
    return texts.withColumn("pred_label", F.expr(label))


def target_ids(words: DataFrame, targets: Sequence[str]) -> list[int]:
    """Ids of the targets that are in the vocabulary, at most one per target."""
    known = words.where(f"array_contains({X.text_array(targets)}, token)") if targets else None
    rows = known.select("token_id").distinct().collect() if known is not None else []
    return sorted(r["token_id"] for r in rows)


def decoded_steps(
    steps: DataFrame, words: DataFrame, targets: Sequence[str], shared: DataFrame | None = None
) -> DataFrame:
    """``subject_id, seq, step, token, p`` of generated ids with the logits they were drawn from.

    The mass of the targets is taken where the logits lie, so that a step moves on as one number,
    whatever the size of the vocabulary. Without a target in the vocabulary it is 0. An id that the
    vocabulary lacks has no token.

    Steps may share logits: they then have ``logits_id`` instead, a key of ``shared`` (``logits_id,
    logits``), and the mass is taken once per list. A step without such a list has no ``p``.
    """
    ids = target_ids(words, targets)
    mass = target_mass("logits", ids) if ids else "0.0D"
    if shared is not None:
        masses = shared.selectExpr("logits_id", f"{mass} AS p")
        steps, mass = lookup_join(steps, masses, "logits_id", "left"), "p"
    sparse = steps.selectExpr("subject_id", "seq", "step", "token_id", f"{mass} AS p")
    named = lookup_join(sparse, words.select("token", "token_id"), "token_id", "left")
    return named.select("subject_id", "seq", "step", "token", "p")


def _folded(listed: str, horizon_days: int, time_bound: bool) -> str:
    """One pass over a sequence's steps: label and the chance of a hit (SQL).

    The state holds the days before a step, the chance that no step before it hit, and the results so
    far. A step counts while the days before it do not exceed the horizon, which for the step that
    passes the horizon is still so.
    """
    early = f"s.days <= {horizon_days}"
    counts = early if time_bound else "true"
    unlisted = "cast(raise_error('unknown gap token') as int)"
    label = f"IF({early}, IF(e.unlisted, {unlisted}, IF(e.hit, 1, s.label)), s.label)"
    state = "named_struct('days', 0L, 'miss', 1.0D, 'score', 0.0D, 'label', 0)"
    step = (
        "named_struct('days', s.days + e.days, "
        f"'miss', IF({counts}, s.miss * (1 - e.p), s.miss), "
        f"'score', IF({counts}, s.score + s.miss * e.p, s.score), "
        f"'label', {label})"
    )
    return f"aggregate({listed}, {state}, (s, e) -> {step})"


def scored_sequences(
    steps: DataFrame,
    targets: Sequence[str],
    horizon_days: int,
    time_bound: bool = True,
    match: str = "contains",
) -> DataFrame:
    """``subject_id, seq, generated_text, pred_label, score``.

    What :func:`generated_texts`, :func:`with_predicted_label` and :func:`first_hit_probability` say
    of a sequence, from one fold over its steps. Steps are dealt by subject and move once: the lists
    of a subject and a join with subjects can use the same dealing. A subject has as many steps as
    the model was allowed to generate for it.

    Gaps and target hits are found per step before that. A target is a single token or a part of one.
    A step without ``p`` adds nothing; ``p`` of 1 or more is certain.
    """
    shown = f"IF({IS_SPECIAL}, NULL, token)"
    days = X.gap_days("token")
    is_gap = f"coalesce(startswith({shown}, 'TIME_'), false)"
    named = steps.selectExpr(
        "subject_id",
        "seq",
        "struct(step, "
        f"{shown} AS token, "
        "least(coalesce(cast(p as double), 0.0D), 1.0D) AS p, "
        f"coalesce(cast({days} as bigint), 0L) AS days, "
        f"({is_gap} AND {days} IS NULL) AS unlisted, "
        f"coalesce({has_target(shown, targets, match)}, false) AS hit) AS e",
    )
    dealt = named.repartition("subject_id")
    whole = dealt.groupBy("subject_id", "seq").agg(F.expr("sort_array(collect_list(e)) AS steps"))
    found = whole.selectExpr(
        "subject_id",
        "seq",
        "array_join(transform(steps, e -> e.token), ' ') AS generated_text",
        X.once(f"{_folded('steps', horizon_days, time_bound)} AS state"),
    )
    return found.selectExpr(
        "subject_id", "seq", "generated_text", "state.label AS pred_label", "state.score AS score"
    )


def regrouped(scored: DataFrame) -> DataFrame:
    """One row per subject with lists in sequence order and the vote share."""
    listed = "sort_array(collect_list(struct(seq, generated_text, pred_label, score)))"
    grouped = scored.groupBy("subject_id").agg(
        F.expr(f"{listed} AS s"), F.expr("avg(pred_label) AS probability")
    )
    return grouped.selectExpr(
        "subject_id",
        "s.generated_text AS generated_text",
        "s.pred_label AS pred_labels",
        "probability",
        "s.score AS probability_scores",
    )


def prediction_rows(
    subjects: DataFrame,
    scored: DataFrame,
    num_predictions: int,
    max_new_tokens: int,
    model_name: str,
) -> DataFrame:
    """Evaluation subjects with their predictions; empty lists where nothing was generated.

    ``subjects`` has ``subject_id, original_text, label_token``.
    """
    lists = ["generated_text", "pred_labels", "probability_scores"]
    return subjects.join(regrouped(scored), "subject_id", "left").selectExpr(
        *subjects.columns,
        *[f"coalesce({name}, array()) AS {name}" for name in lists],
        "probability",
        f"{num_predictions} AS num_predictions",
        f"{max_new_tokens} AS max_new_tokens",
        f"{X.text(model_name)} AS model_name",
    )


def scored_predictions(
    evaluation: DataFrame,
    steps: DataFrame,
    words: DataFrame,
    task: Task,
    num_predictions: int,
    max_new_tokens: int,
    model_name: str,
    time_bound: bool = True,
    shared: DataFrame | None = None,
) -> DataFrame:
    """Prediction rows of an evaluation set from the ids and logits that a model generated for it.

    ``evaluation`` has ``subject_id, text, stopping_time, label_token`` and one row per subject,
    ``steps`` ``subject_id, seq, step, token_id, logits``, ``words`` ``token, token_id``. The original
    text ends at the stopping time. Steps of other subjects are left out. Steps that share logits name
    them as :func:`decoded_steps` says.
    """
    targets = list(task.followup_targets or task.targets)
    subjects = evaluation.selectExpr(
        "subject_id",
        "substring_index(text, ' ', stopping_time) AS original_text",
        "label_token",
    )
    made = decoded_steps(steps, words, targets, shared)
    scored = scored_sequences(made, targets, task.horizon_days, time_bound, task.match)
    return prediction_rows(subjects, scored, num_predictions, max_new_tokens, model_name)


def mean_validation_loss(losses: DataFrame, column: str = "loss") -> DataFrame:
    """One row: mean of the losses that are numbers, and a message if there are none."""
    number = f"nanvl({column}, NULL)"
    none = X.text("there is no numeric loss to average")
    return losses.selectExpr(
        f"avg({number}) AS avg_loss", f"IF(count({number}) = 0, {none}, NULL) AS message"
    )


def example_losses(token_losses: DataFrame, *keys: str) -> DataFrame:
    """Mean token loss per example over labels that are not ignored; 0 if all are."""
    total = f"sum(IF({LABEL_USED}, loss, 0.0D))"
    mean = f"{total} / greatest(count_if({LABEL_USED}), 1) AS test_loss"
    return token_losses.groupBy(*(keys or ("subject_id",))).agg(F.expr(mean))


def subject_losses(token_losses: DataFrame) -> DataFrame:
    """``subject_id, test_loss``; a subject in several batches keeps its last batch's value."""
    per_example = example_losses(token_losses, "subject_id", "batch_id")
    return per_example.groupBy("subject_id").agg(
        F.expr("max_by(test_loss, batch_id) AS test_loss")
    )


def overall_loss(token_losses: DataFrame) -> DataFrame:
    """One row: mean over batches of each batch's mean loss over labels that are not ignored."""
    batches = token_losses.groupBy("batch_id").agg(
        F.expr(f"avg(IF({LABEL_USED}, loss, NULL)) AS loss")
    )
    return batches.selectExpr("avg(loss) AS test_loss", "count(*) AS n_batches")
