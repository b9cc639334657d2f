"""Registered queries that run as streams: each drains its input once and reads its sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.match import lexicon_terms
from ..operators.parse import guard_english, guard_nonempty
from ..streaming import jobs
from . import oracle as O
from .catalog_tables import _CORPUS_SQL, corpus_rows, hash_sql
from .inputs import lexicon, table
from .registry import query, scratch


def stream(spark, sf, name):
    """A table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def drain(df, folder, mode="append"):
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query("stream_lexicon_hits", O.with_(O.DOCS, O.hits()) + "SELECT doc_id, char_start, char_end, term FROM hits")
def _(spark, sf):
    docs = stream(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = jobs.stream_lexicon_hits(guard_english(guard_nonempty(docs)), lexicon_terms(lexicon(spark)))
    return drain(found, scratch(spark))


@query(
    "stream_run_ledger",
    "SELECT date_trunc('hour', ts) AS window_start, user_id AS run_id, count(*) AS steps, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY ALL",
)
def _(spark, sf):
    folder = scratch(spark)
    runs = stream(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("created_at"), F.floor("value").alias("tokens")
    )
    ledger = jobs.stream_run_ledger(runs)

    def write(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{folder}/out")

    # Complete mode: every window is reported, closed or not.
    q = ledger.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(ledger.schema).parquet(f"{folder}/out")


@query(
    "ingest_microbatch",
    O.with_(_CORPUS_SQL)
    + f"""SELECT id, n_chars, round(raw[1] / sqrt(list_sum(list_transform(raw, lambda q: q * q))), 6) AS first_value FROM
  (SELECT 'eric_' || chunk_id AS id, length(chunk_text) AS n_chars, {hash_sql('chunk_text')} AS raw FROM corpus WHERE {O.strip('chunk_text')} <> '')""",
)
def _(spark, sf):
    folder = scratch(spark)
    corpus_rows(spark, sf).write.parquet(f"{folder}/in")
    schema = corpus_rows(spark, sf).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    jobs.ingest_microbatch(source, f"{folder}/store", f"{folder}/dead", f"{folder}/ckpt").awaitTermination()
    return spark.read.parquet(f"{folder}/store").select(
        "id", F.length("text").alias("n_chars"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_value")
    )


@query(
    "ingest_upsert",
    O.with_(_CORPUS_SQL)
    + f"""SELECT id, n_chars, round(raw[1] / sqrt(list_sum(list_transform(raw, lambda q: q * q))), 6) AS first_value FROM
  (SELECT 'eric_' || chunk_id AS id, length(t) AS n_chars, {hash_sql('t')} AS raw FROM (SELECT chunk_id, CASE WHEN CAST(chunk_id AS BIGINT) % 3 = 0 THEN 'again: ' || chunk_text ELSE chunk_text END AS t FROM corpus) WHERE {O.strip('t')} <> '')""",
)
def _(spark, sf):
    """A third of the corpus arrives a second time with another text; the store has one row per id, the later one."""
    folder, rows = scratch(spark), corpus_rows(spark, sf)
    again = rows.filter(F.col("chunk_id").cast("bigint") % 3 == 0).withColumn("chunk_text", F.concat(F.lit("again: "), "chunk_text"))
    for arriving in (rows, again):
        arriving.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        jobs.ingest_microbatch(source, f"{folder}/store", f"{folder}/dead", f"{folder}/ckpt").awaitTermination()
    return jobs.read_store(spark, f"{folder}/store").select(
        "id", F.length("text").alias("n_chars"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_value")
    )


@query(
    "stream_ledger_closed",
    """SELECT date_trunc('hour', ts) AS window_start, user_id AS run_id, count(*) AS steps, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def _(spark, sf):
    """Append mode: a window is written once, when the watermark has passed its end, and its state goes."""
    runs = stream(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("created_at"), F.floor("value").alias("tokens")
    )
    return drain(jobs.stream_run_ledger(runs), scratch(spark))
