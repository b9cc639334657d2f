"""Run telemetry: steps, token ledgers, run log rows, errors, ingest summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import previous_values, running_sums
from ..functions.responses import response_sequence

# Module names per task, and marks of a provider's refusal.
MODULES = {"audit": "DocumentAuditor", "investigate": "EvidenceInvestigator", "consolidate": "ReportConsolidator"}
DEFAULT_MODULE = "Agent"
REFUSAL_MARKERS = (
    "content_filter", "content_policy", "contentpolicyviolation", "content management policy", "responsibleaipolicy",
)
REFUSAL_TEXT = "The model provider's safety filter blocked this text; the audit did not run."
LEDGER_WIDTH = 100_000


def steps_module(task: Column) -> Column:
    return reduce(lambda acc, kv: F.when(task == kv[0], F.lit(kv[1])).otherwise(acc), MODULES.items(), F.lit(DEFAULT_MODULE))


def steps_response_parse(steps: DataFrame, raw: str = "response") -> DataFrame:
    """``response_json``: one value, or several in a row as a list; otherwise the text stays."""
    parsed = steps.withColumn("response_json", response_sequence(F.col(raw)))
    return parsed.withColumn("is_json", F.col("response_json").isNotNull()).withColumn(
        "response_value", F.coalesce("response_json", F.col(raw))
    )


def usage_delta(ledger: DataFrame, *, width: int = LEDGER_WIDTH) -> DataFrame:
    """Tokens of each call from cumulative counters (run_id, step_idx, cum_in, cum_out)."""
    prev = previous_values(ledger, ["run_id"], "step_idx", {"__pi": "cum_in", "__po": "cum_out"}, width=width)
    return prev.withColumn("delta_in", F.col("cum_in") - F.coalesce("__pi", F.lit(0))).withColumn(
        "delta_out", F.col("cum_out") - F.coalesce("__po", F.lit(0))
    ).drop("__pi", "__po")


def usage_cumulative(steps: DataFrame, *, width: int = LEDGER_WIDTH) -> DataFrame:
    """Running totals per run from tokens of each call; a call without usage counts 0."""
    return running_sums(
        steps, ["run_id"], "step_idx",
        {"cum_in": F.col("tokens_in").cast("bigint"), "cum_out": F.col("tokens_out").cast("bigint")}, width=width,
    )


def run_log_rows(steps: DataFrame) -> DataFrame:
    """One row per run; token columns are null when unknown or both zero."""
    out = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("step_count"), F.sum("tokens_in").alias("__i"), F.sum("tokens_out").alias("__o")
    )
    used = (F.coalesce("__i", F.lit(0)) != 0) | (F.coalesce("__o", F.lit(0)) != 0)
    return out.select(
        "run_id", "step_count", F.when(used, F.coalesce("__i", F.lit(0))).alias("tokens_in"),
        F.when(used, F.coalesce("__o", F.lit(0))).alias("tokens_out"),
    )


def is_refusal(error: Column) -> Column:
    low = F.lower(error)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in REFUSAL_MARKERS])


def error_classify(errors: DataFrame, error: str = "error", text: str = REFUSAL_TEXT) -> DataFrame:
    refusal = F.coalesce(is_refusal(F.col(error)), F.lit(False))
    return errors.withColumn("is_refusal", refusal).withColumn("friendly", F.when(refusal, text).otherwise(F.col(error)))


def ingest_summary(attempts: DataFrame, batch_size: int = 64) -> DataFrame:
    """From attempted rows with ``failed``: attempted, ingested, skipped, batches."""
    out = attempts.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("failed").alias("skipped"))
    return out.select(
        "attempted", (F.col("attempted") - F.col("skipped")).alias("ingested"), "skipped",
        F.ceil((F.col("attempted") - F.col("skipped")) / F.lit(batch_size)).cast("bigint").alias("batches"),
    )
