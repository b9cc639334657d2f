"""Consolidation of confirmed findings: retraction, patterns, order, integrity of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts of the consolidation result.
RETRACTION = "weak grounding — likely false positive"
NOTHING_CONFIRMED = "No inclusivity issues were confirmed."
QUOTE_LIMIT = 80

# Categories from most to least severe.
SEVERITY = (
    "factually-incorrect", "biased", "potentially-offensive", "exclusionary", "ableist", "outdated", "gendered",
)


def confirmed_only(investigations: DataFrame) -> DataFrame:
    return investigations.filter("verdict = 'confirmed'")


def consolidation_context(documents: DataFrame, investigations: DataFrame) -> DataFrame:
    """Per document what consolidation sees: counts, and whether it is skipped."""
    per_doc = investigations.groupBy("doc_id").agg(
        F.count_if(F.col("verdict") == "confirmed").alias("confirmed"),
        F.count_if(F.col("verdict") != "confirmed").alias("rejected"),
        F.count_if((F.col("verdict") == "confirmed") & F.col("needs_human_review")).alias("needs_review"),
    )
    joined = documents.select("doc_id").join(per_doc, "doc_id", "left").na.fill(0, ["confirmed", "rejected", "needs_review"])
    skipped = F.col("confirmed") == 0
    return joined.withColumn("skipped", skipped).withColumn("summary", F.when(skipped, NOTHING_CONFIRMED))


def finding_compact(investigations: DataFrame) -> DataFrame:
    """Seven fields per confirmed finding; long quotes shortened, at most two evidence titles."""
    quote = F.when(F.length("quote") > QUOTE_LIMIT, F.concat(F.left("quote", F.lit(QUOTE_LIMIT - 3)), F.lit("..."))).otherwise(
        F.col("quote")
    )
    titles = F.filter(
        F.transform(F.slice("evidence", 1, 2), lambda e: e["metadata"]["title"]), lambda t: F.coalesce(t, F.lit("")) != ""
    )
    return confirmed_only(investigations).select(
        "doc_id", "cand_idx", "cand_id", "category", "secondary_category", "confidence",
        F.size("occurrences").alias("occurrences"), quote.alias("quote"), titles.alias("evidence_titles"),
    )


def retract_first_low(investigations: DataFrame) -> DataFrame:
    """Confirmed findings in candidate order; the first of low confidence is retracted."""
    doc = Window.partitionBy("doc_id")
    first_low = F.min(F.when(F.col("confidence") == "low", F.col("cand_idx"))).over(doc)
    out = confirmed_only(investigations).withColumn("retracted", F.coalesce(F.col("cand_idx") == first_low, F.lit(False)))
    return out.withColumn("rationale", F.when(F.col("retracted"), F.lit(RETRACTION)))


def patterns_by_category(decided: DataFrame) -> DataFrame:
    """Kept findings of one category, two or more, form a pattern."""
    kept = decided.filter(~F.col("retracted"))
    grouped = kept.groupBy("doc_id", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "cand_id"))), lambda s: s["cand_id"]).alias("finding_ids"),
        F.min("cand_idx").alias("pattern_ord"),
    )
    return grouped.filter(F.size("finding_ids") >= 2).select(
        "doc_id", "pattern_ord", F.concat(F.lit("recurring "), "category", F.lit(" phrasing")).alias("framing"),
        "category", "finding_ids",
    )


def severity_rank(category: Column) -> Column:
    rank = F.lit(len(SEVERITY))
    for i, c in enumerate(SEVERITY):
        rank = F.when(category == c, F.lit(i)).otherwise(rank)
    return rank


def severity_order(decided: DataFrame) -> DataFrame:
    """Position of each kept finding, most severe category first."""
    order = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("category")), "cand_idx")
    return decided.filter(~F.col("retracted")).withColumn("severity_pos", F.row_number().over(order))


def consolidation_integrity(confirmed: DataFrame, kept: DataFrame, retracted: DataFrame) -> DataFrame:
    """Decisions for every confirmed finding from a reply that may be wrong.

    ``confirmed``: doc_id, cand_idx, cand_id. ``kept``: doc_id, pos, cand_id. ``retracted``:
    doc_id, pos, cand_id, rationale. Unknown ids are dropped, an id on both lists is retracted,
    an id on neither is kept after the listed ones.
    """
    ids = confirmed.select("doc_id", "cand_id")
    out = retracted.join(ids, ["doc_id", "cand_id"], "left_semi").groupBy("doc_id", "cand_id").agg(
        F.min("pos").alias("pos"), F.coalesce(F.max_by("rationale", "pos"), F.lit("")).alias("rationale")
    )
    out = out.withColumn("retracted", F.lit(True)).withColumn("grp", F.lit(2))
    listed = (
        kept.join(ids, ["doc_id", "cand_id"], "left_semi")
        .join(out.select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_anti")
        .groupBy("doc_id", "cand_id").agg(F.min("pos").alias("pos"))
        .withColumn("grp", F.lit(0))
    )
    missing = (
        confirmed.join(out.select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_anti")
        .join(kept.select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_anti")
        .select("doc_id", "cand_id", F.col("cand_idx").alias("pos"), F.lit(1).alias("grp"))
    )
    plain = [F.lit(None).cast("string").alias("rationale"), F.lit(False).alias("retracted")]
    columns = ["doc_id", "cand_id", "pos", "grp", "rationale", "retracted"]
    rows = out.select(columns).unionByName(listed.select("*", *plain).select(columns)).unionByName(
        missing.select("*", *plain).select(columns)
    )
    order = Window.partitionBy("doc_id").orderBy("grp", "pos", "cand_id")
    return rows.withColumn("final_pos", F.row_number().over(order)).select("doc_id", "cand_id", "retracted", "rationale", "final_pos")


def pattern_integrity(patterns: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Patterns (doc_id, pattern_ord, framing, category, finding_ids) without unknown ids; empty ones go."""
    ids = patterns.select("doc_id", "pattern_ord", F.posexplode("finding_ids").alias("pos", "cand_id")).join(
        confirmed.select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_semi"
    )
    known = ids.groupBy("doc_id", "pattern_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "cand_id"))), lambda s: s["cand_id"]).alias("finding_ids")
    )
    return patterns.select(
        "doc_id", "pattern_ord", F.coalesce("framing", F.lit("")).alias("framing"), F.coalesce("category", F.lit("")).alias("category")
    ).join(known, ["doc_id", "pattern_ord"])


def keep_all_on_parse_failure(confirmed: DataFrame, replies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Where a document's reply could not be read (``parse_failed``), every finding is kept."""
    failed = replies.filter("parse_failed").select("doc_id").distinct().withColumn("parse_failed", F.lit(True))
    base = confirmed.select("doc_id", "cand_idx", "cand_id").join(decisions, ["doc_id", "cand_id"], "left").join(failed, "doc_id", "left")
    bad = F.coalesce("parse_failed", F.lit(False))
    return base.select(
        "doc_id", "cand_idx", "cand_id", bad.alias("parse_failed"),
        F.when(bad, False).otherwise(F.coalesce("retracted", F.lit(False))).alias("retracted"),
        F.when(~bad, F.col("rationale")).alias("rationale"),
    )
