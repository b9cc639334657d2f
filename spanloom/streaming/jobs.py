"""Structured Streaming forms of ingest, lexicon matching and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import DEFAULT_BATCH, raw_hits
from ..sources.corpus import corpus_project, corpus_scan, embed_corpus

MAX_ATTEMPTS = 3


def stream_lexicon_hits(documents: DataFrame, terms: list[str], batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """Lexicon hits of a document stream; no state, each document is complete in its row."""
    return raw_hits(documents, terms, batch_size)


def stream_run_ledger(runs: DataFrame, *, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Token sums per run and window of a run-log stream (run_id, created_at, tokens)."""
    return (
        runs.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", window).alias("w"), "run_id")
        .agg(F.count(F.lit(1)).alias("steps"), F.sum("tokens").alias("tokens"))
        .select(F.col("w.start").alias("window_start"), "run_id", "steps", "tokens")
    )


def ingest_batch(rows: DataFrame, batch_id: int, store_path: str, dead_path: str, *, dim: int = 64, embedder=None, attempts: int = MAX_ATTEMPTS) -> bool:
    """Embed one micro-batch and write it to the vector table; a failing batch is set aside.

    The batch number is a partition that a retry overwrites, so a batch that is run again
    after a lost executor or driver leaves no duplicates.
    """
    last: Exception | None = None
    for _ in range(attempts):
        try:
            out = embed_corpus(corpus_project(corpus_scan(rows)), dim, embedder)
            out.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")
            return True
        except Exception as e:  # noqa: BLE001 - any failure of a batch sets it aside
            last = e
    rows.withColumn("error", F.lit(type(last).__name__)).write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
    return False


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    """The vector table as it stands: one row per id, the one of the last batch that wrote it.

    An aggregate, reduced inside each task first, so an id that was written very often is no hot group. Of several rows of one id
    in the same batch, whose order a batch does not define, the greatest text counts.
    """
    rows = spark.read.parquet(store_path)
    payload = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*payload), F.struct(F.col("batch").cast("bigint"), "text")).alias("p")).select("id", "p.*")


def ingest_microbatch(corpus: DataFrame, store_path: str, dead_path: str, checkpoint: str, *, dim: int = 64, embedder=None):
    """Start the ingest of a corpus stream; batch size is set on the source (maxFilesPerTrigger)."""

    def run(rows: DataFrame, batch_id: int) -> None:
        ingest_batch(rows, batch_id, store_path, dead_path, dim=dim, embedder=embedder)

    return (
        corpus.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
