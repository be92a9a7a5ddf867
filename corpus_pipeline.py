"""Documents to training tokens: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import bpe, common, mixing, pii, queries, similar, toxicity
from sojourn.session import materialise, stored

SHINGLE_WORDS = 5
# Stages fit models, draw at random and hash in ways that SQL cannot express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; the model learns from the labelled ones.

    Without a usable label, or if nothing was learnt from them, nothing is known and all stay.
    """
    common.ship(spark)
    model = materialise(toxicity.fit(docs, common.table(spark, sf_dir, "labels")))
    if model.isEmpty():
        return docs
    name = common.fresh(docs, "score")
    scored = toxicity.score(docs, model, name)
    return scored.where(f"{name} < {toxicity.THRESHOLD}D").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five-word shingles."""
    common.ship(spark)
    return similar.one_of_each(docs, SHINGLE_WORDS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and the length brought up to date."""
    common.ship(spark)
    masked = pii.masked(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(kind))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard."""
    common.ship(spark)
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and digests of the ids and of the text they decode to."""
    common.ship(spark)
    rows = docs.select("doc_id", "source", "text")
    return bpe.round_trip(rows, queries.RANKS, queries.PATTERN, keep=("doc_id", "source", "ids"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
