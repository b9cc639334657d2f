"""Scoring: binary sentence metrics and character-overlap metrics of spans."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import overlap_chars, overlapping_spans
from ..functions.text import strip
from ..functions.wordtrie import batched_regexes
from .candidates import DEFAULT_RULES, rule_classify
from .match import DEFAULT_BATCH, MAX_LOOKUP_TERMS, document_lookup, lexicon_terms
from .parse import chunk_table

MIN_OVERLAP = 0.5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(df: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to tp, fp, fn; 0 where a denominator is 0."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_prf(scored: DataFrame) -> DataFrame:
    """One row from (predicted, expected) booleans. A null on either side is an unmatched item: an error."""
    paired = scored.filter(
        F.assert_true(F.col("predicted").isNotNull() & F.col("expected").isNotNull(), F.lit("predictions and gold differ in length")).isNull()
    )
    p, e = F.col("predicted"), F.col("expected")
    return _prf(
        paired.agg(
            F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn")
        )
    )


def per_label_breakdown(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.coalesce("expected_category", F.lit("Correct")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("predicted").alias("flagged")
    )


def accuracy_recall(labelled: DataFrame) -> DataFrame:
    """From (label, expected): accuracy, flag recall, clean precision; 'ask' counts as a flag."""
    got, want = F.col("label") != "skip", F.col("expected")
    return labelled.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(got & want).alias("tp"), F.count_if(~got & want).alias("fn"),
        F.count_if(~got & ~want).alias("tn"), F.count_if(got & ~want).alias("fp"),
    ).withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("n"))).withColumn(
        "flag_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    ).withColumn("clean_precision", _ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def normalize_gold_label(col: Column) -> Column:
    return F.replace(F.lower(strip(col)), F.lit(" "), F.lit("-"))


def _gold(gold: DataFrame) -> DataFrame:
    labels = F.transform("labels", normalize_gold_label)
    return gold.select(
        "doc_id", "gold_idx", F.col("char_start").alias("g_start"), F.col("char_end").alias("g_end"), labels.alias("gold_labels"),
        F.exists(labels, lambda x: x != "correct").alias("is_problem"),
    )


def best_gold_match(predicted: DataFrame, gold: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Each prediction with its best gold span, or nulls.

    The overlap is measured against the gold length; the largest share wins, then the lowest
    gold index. One left join and one aggregate: predictions are read once.
    """
    pairs = overlapping_spans(
        predicted, _gold(gold).filter("g_end > g_start"), left_span=("char_start", "char_end"), right_span=("g_start", "g_end"), how="left"
    )
    share = overlap_chars(F.col("char_start"), F.col("char_end"), F.col("g_start"), F.col("g_end")) / (F.col("g_end") - F.col("g_start"))
    rest = [c for c in predicted.columns if c not in ("doc_id", "pred_idx")]
    match = F.struct("gold_idx", "frac", "gold_labels", "is_problem")
    ok = F.col("frac") >= min_overlap
    best = pairs.withColumn("frac", F.when(F.col("gold_idx").isNotNull(), share)).groupBy("doc_id", "pred_idx").agg(
        F.any_value(F.struct(*rest)).alias("p"),
        F.max_by(F.when(ok, match), F.when(ok, F.struct("frac", F.negative("gold_idx")))).alias("m"),
    )
    return best.select("doc_id", "pred_idx", "p.*", "m.*")


def match_outcome(matched: DataFrame) -> DataFrame:
    """unmatched_fp, fp_on_correct, tp or label_miss per prediction."""
    category = normalize_gold_label(F.col("category"))
    return matched.withColumn("pred_label", category).withColumn(
        "outcome",
        F.when(F.col("gold_idx").isNull(), "unmatched_fp")
        .when(~F.col("is_problem"), "fp_on_correct")
        .when(F.array_contains("gold_labels", F.col("pred_label")), "tp")
        .otherwise("label_miss"),
    )


def _gold_labels(gold: DataFrame) -> DataFrame:
    """One row per problem span and non-correct label."""
    g = _gold(gold).filter("is_problem")
    return g.select("doc_id", "gold_idx", F.explode("gold_labels").alias("label")).filter("label <> 'correct'")


def per_label_prf(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """Strict counts per label: tp per prediction, fn per gold label of unmatched problem spans."""
    predicted = outcomes.groupBy(F.col("pred_label").alias("label")).agg(
        F.count_if(F.col("outcome") == "tp").alias("tp"), F.count_if(F.col("outcome") != "tp").alias("fp")
    )
    hit = outcomes.filter("outcome = 'tp'").select("doc_id", "gold_idx").distinct()
    missed = _gold_labels(gold).join(hit, ["doc_id", "gold_idx"], "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("fn"))
    joined = predicted.join(missed, "label", "full_outer").na.fill(0, ["tp", "fp", "fn"])
    return _prf(joined)


def micro_prf(per_label: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("tp", "fp", "fn")]
    return _prf(per_label.agg(*sums))


def span_detection(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """Label-agnostic: was the place found, whatever it was called."""
    on_problem = F.col("outcome").isin("tp", "label_miss")
    counts = outcomes.agg(F.count_if(on_problem).alias("tp"), F.count_if(~on_problem).alias("fp"))
    seen = outcomes.filter(on_problem).select("doc_id", "gold_idx").distinct()
    missed = _gold(gold).filter("is_problem").join(seen, ["doc_id", "gold_idx"], "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    parts = counts.withColumn("fn", F.lit(0)).unionByName(missed.select(F.lit(0).alias("tp"), F.lit(0).alias("fp"), "fn"))
    return _prf(parts.agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]))


def gold_label_recall(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    seen = outcomes.filter(F.col("outcome").isin("tp", "label_miss")).select("doc_id", "gold_idx").distinct().withColumn("seen", F.lit(True))
    joined = _gold_labels(gold).join(seen, ["doc_id", "gold_idx"], "left")
    out = joined.groupBy("label").agg(F.count("seen").alias("detected"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("recall", F.col("detected") / F.col("total"))


def fp_on_correct_rate(outcomes: DataFrame) -> DataFrame:
    counts = outcomes.agg(F.count_if(F.col("outcome") == "fp_on_correct").alias("fp_on_correct"), F.count(F.lit(1)).alias("n_predicted"))
    return counts.withColumn("rate", _ratio(F.col("fp_on_correct"), F.col("n_predicted")))


def score_overview(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """Label misses, unmatched predictions and sizes, one row."""
    n = outcomes.agg(
        F.count_if(F.col("outcome") == "label_miss").alias("label_miss"), F.count_if(F.col("outcome") == "unmatched_fp").alias("unmatched_fp"),
        F.count(F.lit(1)).alias("n_predicted"),
    )
    g = _gold(gold).agg(F.count_if("is_problem").alias("n_gold_problem_spans"))
    names = [*n.columns, *g.columns]
    both = n.unionByName(g, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in names])


def predicted_spans(decided: DataFrame) -> DataFrame:
    """Every occurrence of every kept, confirmed finding."""
    kept = decided.filter("verdict = 'confirmed' AND NOT retracted")
    return kept.select("doc_id", "cand_idx", "category", F.posexplode("occurrences").alias("occ_idx", "o")).select(
        "doc_id", F.concat_ws(".", "cand_idx", "occ_idx").alias("pred_idx"), "category", "o.char_start", "o.char_end"
    )


def baseline_audit(documents: DataFrame, lexicon: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Fixed sequence: chunk, look up, skip chunks without a hit, classify, record flags. A vocabulary that is a pattern takes one pass over the texts."""
    terms = lexicon_terms(lexicon, MAX_LOOKUP_TERMS)
    chunks = chunk_table(documents)
    if terms is None:
        hit = document_lookup(documents, lexicon).select("doc_id", "chunk_idx").distinct()
        chunks = chunks.join(hit, ["doc_id", "chunk_idx"], "left_semi")
    else:
        chunks = chunks.filter(reduce(or_, [F.rlike("text", F.lit(p)) for p in batched_regexes(terms, DEFAULT_BATCH)], F.lit(False)))
    flagged = rule_classify(chunks.select("doc_id", "chunk_idx", "chunk_id", "text"), rules).filter("label = 'flag'")
    return flagged.select(
        "doc_id", "chunk_idx", "chunk_id", F.col("text").alias("span"), "label", F.col("flag_category").alias("category"), "reason",
        F.lit("medium").alias("confidence"),
    )


def control_flow_divergence(agent_events: DataFrame, baseline_events: DataFrame) -> DataFrame:
    """Event types of one side, the other, or both (inputs: one column ``event``)."""
    a, b = agent_events.select("event").distinct(), baseline_events.select("event").distinct()
    return (
        a.subtract(b).withColumn("side", F.lit("agent_only"))
        .unionByName(a.intersect(b).withColumn("side", F.lit("shared")))
        .unionByName(b.subtract(a).withColumn("side", F.lit("baseline_only")))
    )


def parse_failure_warning(stats: DataFrame) -> DataFrame:
    failed = F.col("windows_parse_failed")
    text = F.concat(failed.cast("string"), F.lit(" windows returned unparseable output — results are a lower bound."))
    return stats.select("doc_id", "windows_parse_failed", F.when(failed > 0, text).alias("warning"))


