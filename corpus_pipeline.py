"""From raw documents to a training mixture: language, near-duplicates, benchmark passages, personal data, source weights.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents. A stage can be
written as Parquet and reread as the input of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import contamination, language, mixing, neardup, pii
from spanloom.llm.common import checkpointed, small_batches, table

#: Least probability of the predicted language.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go. Languages are learned from the labelled documents; without any label, all with letters stay."""
    small_batches(spark)
    model = language.fit(docs, F.lit(True))
    if not model["classes"]:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    judged, name = language.predict(docs, model)
    found = F.col(name)
    return judged.filter((found["lang_pred"] != language.UNKNOWN) & (found["score"] >= MIN_LANGUAGE_SCORE)).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    small_batches(spark)
    found, name = contamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~contamination.is_contaminated(F.col(name))).drop(name)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    small_batches(spark)
    return docs.withColumn("text", pii.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their size; the mixture is as large as its input."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
