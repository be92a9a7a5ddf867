"""File sources and sinks.

Sinks overwrite their target, so that a repeated run does not duplicate rows, and take
an ``egress`` policy, which judges the target before any work.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.operators.export import seeded_sample
from sojourn.operators.vocab import IS_SPECIAL, with_special_tokens
from sojourn.sources.guard import CLOSED, Egress

# Prediction columns in file order; lists are JSON in the file.
PREDICTION = {
    "original_text": "string",
    "generated_text": "array<string>",
    "pred_labels": "array<int>",
    "subject_id": "bigint",
    "label_token": "int",
    "probability": "double",
    "probability_scores": "array<double>",
    "num_predictions": "int",
    "max_new_tokens": "int",
    "model_name": "string",
}


# ---- Events ----

# Rows of a file that one task writes.
SINGLE_FILE_ROWS = 10_000_000


def read_events_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Event CSV with a fixed schema; empty fields are null."""
    return spark.read.schema(S.EVENT).option("header", True).csv(path)


def count_csv_rows(spark: SparkSession, path: str) -> int:
    """Data rows of a CSV, headers excluded."""
    return read_events_csv(spark, path).count()


def write_split_events(
    events: DataFrame, path: str, form: str = "csv", egress: Egress = CLOSED
) -> None:
    """One folder per ``split``, each sorted by subject and time across its files."""
    egress.admit(path)
    ordered = events.repartitionByRange("split", "subject_id", "time")
    ordered = ordered.sortWithinPartitions("split", "subject_id", "time")
    writer = ordered.write.mode("overwrite").partitionBy("split")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


# ---- Sequences ----


def write_sequence_text(
    sequences: DataFrame, path: str, egress: Egress = CLOSED
) -> None:
    """One sequence per line."""
    egress.admit(path)
    sequences.select("text").write.mode("overwrite").text(path)


def write_sequence_csv(
    sequences: DataFrame, path: str, egress: Egress = CLOSED
) -> None:
    egress.admit(path)
    named = sequences.select("subject_id", F.col("text").alias("sequence"))
    named.write.mode("overwrite").option("header", True).csv(path)


def read_sequence_csv(spark: SparkSession, path: str) -> DataFrame:
    named = spark.read.schema("subject_id bigint, sequence string").option("header", True)
    return named.csv(path).withColumnRenamed("sequence", "text")


# ---- Vocabulary ----


def write_vocabulary(vocab: DataFrame, path: str, egress: Egress = CLOSED) -> None:
    """Tokens one per line in id order, special tokens left out, as a single small text file.

    The vocabulary is bounded by the code system, so one file is right here; a larger one raises.
    """
    egress.admit(path)
    _small(vocab)
    lines = vocab.where(f"NOT ({IS_SPECIAL})").orderBy("token_id").select("token")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, token_id`` of a one-token-per-line file, with the special tokens added.

    The id is the line index. The whole file is read as one value, because only then is its line
    order part of the data.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = "split(regexp_replace(value, '\\n$', ''), '\n')"
    indexed = whole.selectExpr(f"posexplode({lines}) AS (pos, token)")
    words = indexed.selectExpr("trim(token) AS token", "cast(pos as bigint) AS token_id")
    return with_special_tokens(words)


# ---- Datasets ----


def write_dataset(
    dataset: DataFrame,
    path: str,
    by: Sequence[str] = ("split",),
    egress: Egress = CLOSED,
) -> None:
    """Parquet, one folder per value of ``by``; ``by=()`` writes an unsplit dataset."""
    egress.admit(path)
    dataset.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_evaluation_set(
    rows: DataFrame, path: str, egress: Egress = CLOSED
) -> None:
    write_dataset(rows, path, ("task", "label_time_range"), egress=egress)


def split_names(spark: SparkSession, path: str) -> list[str]:
    """Splits of a dataset: the names of its folders; no row is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (entry.getPath().getName() for entry in entries if entry.isDirectory())
    return sorted(unquote(n.removeprefix("split=")) for n in names if n.startswith("split="))


def read_dataset(
    spark: SparkSession,
    path: str,
    split: str = "test",
    sample_size: int | None = None,
    seed=42,
) -> DataFrame:
    """A dataset's rows: one split, or ``all``; an unsplit dataset has no choice.

    The splits are the folders that :func:`write_dataset` made of them.

    ``sample_size`` takes that many rows of each split by seeded order. Rows are subjects here, so
    the order is by ``subject_id``.
    """
    rows = spark.read.parquet(path)
    if "split" in rows.columns:
        names = split_names(spark, path)
        if split != "all":
            if split not in names:
                raise ValueError(f"split {split!r} not found; available: {names}")
            rows, names = rows.where(f"split = '{split}'"), [split]
        if sample_size is None:
            return rows
        parts = [
            seeded_sample(rows.where(f"split = '{name}'"), sample_size, seed=seed)
            for name in names
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    return rows if sample_size is None else seeded_sample(rows, sample_size, seed=seed)


# ---- Predictions and losses ----


def write_predictions(
    predictions: DataFrame, path: str, egress: Egress = CLOSED
) -> None:
    """CSV with list columns as JSON."""
    egress.admit(path)
    flat = predictions.selectExpr(
        *[f"to_json({c}) AS {c}" if t.startswith("array") else c for c, t in PREDICTION.items()]
    )
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions CSV with its lists parsed as data, never evaluated."""
    kinds = {c: "string" if t.startswith("array") else t for c, t in PREDICTION.items()}
    flat = spark.read.schema(", ".join(f"{c} {t}" for c, t in kinds.items()))
    return (
        flat.option("header", True)
        .option("escape", '"')
        .csv(path)
        .selectExpr(
            *[
                f"from_json({c}, '{t}') AS {c}" if t.startswith("array") else c
                for c, t in PREDICTION.items()
            ]
        )
    )


def write_subject_losses(
    losses: DataFrame, path: str, egress: Egress = CLOSED
) -> None:
    egress.admit(path)
    losses.select("subject_id", "test_loss").write.mode("overwrite").option("header", True).csv(path)


def _small(df: DataFrame) -> None:
    n = df.count()
    if n > SINGLE_FILE_ROWS:
        raise ValueError(f"{n} rows are too many for one file of {SINGLE_FILE_ROWS}")


def write_dictionary(dictionary: DataFrame, path: str, egress: Egress = CLOSED) -> None:
    """Code dictionary CSV, sorted by code; a small lookup table."""
    egress.admit(path)
    _small(dictionary)
    dictionary.orderBy("code").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_task_codes(spark: SparkSession, path: str) -> DataFrame:
    """Task definitions: CSV of ``task, concept_id``."""
    return spark.read.schema(S.TASK_CODES).option("header", True).csv(path)
