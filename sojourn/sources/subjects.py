"""A store of events that answers questions about one subject.

    path/version=<name>/events/bucket=<n>   events, ordered by subject and time within a bucket
    path/version=<name>/breaks, /words      what the sequences of that version are made with
    path/versions                           a row per complete version

Rows lie in ``n_buckets`` folders by a hash of the subject, so a lookup lists and reads one of them, and
of its files the row groups that may hold the subject. Buckets are written by ranges of (bucket,
subject, time), so a subject with a large part of all events is spread over files. A version is visible
once its row in ``versions`` is written, which is the last thing done; a run that failed before is
overwritten by the next one of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.sources.guard import CLOSED, Egress

VERSIONS = "version string, n_buckets int, written timestamp"
BUCKETS = 256


def bucket_of(subject_id: str | int, n_buckets: int) -> str:
    """Bucket of a subject (SQL)."""
    return f"int(pmod(xxhash64(cast({subject_id} as bigint)), {n_buckets}L))"


@dataclass(frozen=True)
class SubjectStore:
    """One version of a store."""

    path: str
    version: str
    n_buckets: int
    events: DataFrame
    breaks: DataFrame
    words: DataFrame

    def events_of(self, subject_id: int) -> DataFrame:
        """A subject's events; the bucket is a literal by then, so other folders are not listed."""
        spark = self.events.sparkSession
        number = spark.sql(f"SELECT {bucket_of(subject_id, self.n_buckets)} AS n").first()["n"]
        rows = self.events.where(f"bucket = {number} AND subject_id = {int(subject_id)}")
        return rows.drop("bucket")


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(f"{path}/versions")


def write_subject_store(
    events: DataFrame,
    breaks: DataFrame,
    words: DataFrame,
    path: str,
    version: str,
    n_buckets: int = BUCKETS,
    egress: Egress = CLOSED,
) -> None:
    """Add a version; one that is complete is never written again.

    Choose ``n_buckets`` so that a bucket is a few files. Events without subject are left out, as no
    lookup finds them.
    """
    egress.admit(path)
    if n_buckets < 1:
        raise ValueError(f"at least one bucket is needed, not {n_buckets}")
    if not version or not version.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"{version!r} is no name of a version: letters, digits, - and _ are")
    spark = events.sparkSession
    if version in _complete(spark, path):
        raise ValueError(f"version {version!r} is complete already")
    at = f"{path}/version={version}"
    dealt = events.where("subject_id IS NOT NULL").withColumn(
        "bucket", F.expr(bucket_of("subject_id", n_buckets))
    )
    dealt = dealt.repartitionByRange("bucket", "subject_id", "time")
    dealt = dealt.sortWithinPartitions("bucket", "subject_id", "time")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/events")
    breaks.select("code", "breaks").write.mode("overwrite").parquet(f"{at}/breaks")
    words.select("token", "token_id").write.mode("overwrite").parquet(f"{at}/words")
    row = spark.range(1).selectExpr(
        f"'{version}' AS version", f"{n_buckets} AS n_buckets", "current_timestamp() AS written"
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _complete(spark: SparkSession, path: str) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return set()
    return {r["version"] for r in versions(spark, path).select("version").distinct().collect()}


def open_subject_store(spark: SparkSession, path: str, version: str | None = None) -> SubjectStore:
    """A named version, or the one written last."""
    known = versions(spark, path)
    if version is not None:
        known = known.where(F.col("version") == version)
    row = known.orderBy(F.desc("written"), F.desc("version")).first()
    if row is None:
        raise ValueError(f"{path} has no complete version" + (f" {version!r}" if version else ""))
    at = f"{path}/version={row['version']}"
    parts = (spark.read.parquet(f"{at}/{part}") for part in ("events", "breaks", "words"))
    return SubjectStore(path, row["version"], row["n_buckets"], *parts)
