"""Registered queries: investigation, consolidation, report, evaluation, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sizes import cut_lineage
from ..functions.spans import overlap_chars
from ..operators import align as A
from ..operators import candidates as C
from ..operators import consolidate as K
from ..operators import evaluate as E
from ..operators import investigate as I
from ..operators import parse as P
from ..operators import report as R
from ..operators.passages import place_passages
from . import oracle as O
from .audit import run_audit
from .catalog_tables import _ladder_sql, hash_sql, ladder_corpus
from .catalog_text import _CHUNK_SQL, _CLASSIFY_SQL, audited, documents, guarded, hits, read_once
from .inputs import POLICY, RULES, WINDOW_TOKENS, evidence_vectors, lexicon, raw_documents, table
from .registry import query


def audit(spark, sf, flagged_only=False):
    """The audit without sentences and paragraphs; ``flagged_only`` for queries on candidates alone, which other documents do not have."""
    return run_audit(
        documents(spark, sf), evidence_vectors(spark, sf), RULES, window_tokens=WINDOW_TOKENS, materialize=True, policy=POLICY,
        context=False, flagged_only=flagged_only,
    )


_INV_SQL = f"""
asked AS (SELECT DISTINCT category || ': ' || quote AS query FROM cands),
qv AS (SELECT query, {hash_sql('query')} AS v FROM asked),
sc AS (SELECT query, vec_id, label, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM qv CROSS JOIN embeddings),
r15 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM sc QUALIFY r <= 15),
rdoc AS (SELECT * FROM r15 QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY r) = 1),
ev AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r) AS n FROM rdoc QUALIFY n <= 3),
evq AS (SELECT query, max(score) AS top, count(*) AS n_ev, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY n) AS ids,
  string_agg('   - source: Evidence ' || vec_id || ', ' || (2000 + label) || ', https://example.org/' || vec_id || chr(10), '' ORDER BY n) AS md FROM ev GROUP BY query),
judg AS (SELECT c.doc_id, c.cand_idx, 'cand' || lpad(c.cand_idx::VARCHAR, 4, '0') AS cand_id, c.quote, c.category, c.reason, c.char_start, c.char_end, e.query, e.top, e.n_ev, e.ids, e.md, r.replacement,
  contains(lower(c.quote), '{POLICY.technical}') AS tech, c.n_occ AS seen, CAST((length(d.ft) - length(replace(lower(d.ft), lower(c.quote), ''))) / length(c.quote) AS INTEGER) AS spread
  FROM cands c JOIN evq e ON e.query = c.category || ': ' || c.quote JOIN rules r ON r.word = lower(c.quote) JOIN docs d ON d.doc_id = c.doc_id),
inv AS (SELECT * EXCLUDE (replacement, seen, spread, tech), CASE WHEN tech THEN 'rejected' ELSE 'confirmed' END AS verdict,
  CASE WHEN tech THEN 'technical usage in context' WHEN top >= {POLICY.sufficient} THEN 'corroborated by retrieved corpus evidence [1]' ELSE 'weak evidence' END AS explanation, CASE WHEN tech THEN '' ELSE replacement END AS rewrite,
  CASE WHEN tech THEN 'medium' WHEN top >= {POLICY.strong} THEN 'high' WHEN top >= {POLICY.sufficient} THEN 'medium' ELSE 'low' END AS confidence, NOT tech AND top < {POLICY.sufficient} AS needs_human_review,
  CAST(CASE WHEN tech THEN seen ELSE spread END AS INTEGER) AS n_occ FROM judg),
decided AS (SELECT *, coalesce(cand_idx = min(cand_idx) FILTER (confidence = 'low') OVER (PARTITION BY doc_id), false) AS retracted FROM inv WHERE verdict = 'confirmed'),
pats AS (SELECT doc_id, category, min(cand_idx) AS pattern_ord, string_agg(cand_id, ',' ORDER BY cand_idx) AS finding_ids, count(*) AS n FROM decided WHERE NOT retracted GROUP BY doc_id, category HAVING count(*) >= 2),
summ AS (SELECT c.doc_id, CAST(c.n_windows AS BIGINT) AS windows, coalesce(i.n, 0) AS candidates, coalesce(i.ok, 0) AS confirmed, coalesce(i.rej, 0) AS rejected, coalesce(t.ret, 0) AS retracted, coalesce(i.rev, 0) AS needs_human_review,
  coalesce(p.n, 0) AS patterns FROM capped c LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (verdict = 'confirmed') AS ok, count(*) FILTER (verdict = 'rejected') AS rej, count(*) FILTER (needs_human_review) AS rev FROM inv GROUP BY 1) i USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (retracted) AS ret FROM decided GROUP BY 1) t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM pats GROUP BY 1) p USING (doc_id))"""

_AUDIT = O.with_(*O.AUDIT, _INV_SQL)


@query("search_query_build", _AUDIT + "SELECT doc_id, cand_id, query FROM inv")
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select("doc_id", "cand_id", I.search_query(F.col("category"), F.col("quote")).alias("query"))


@query("evidence_accumulate", _AUDIT + "SELECT doc_id, cand_id, ids, CAST(n_ev AS INTEGER) AS n_evidence FROM inv")
def _(spark, sf):
    ids = F.array_join(F.transform("evidence", lambda e: e["id"]), ",")
    return audit(spark, sf, flagged_only=True).investigations.select("doc_id", "cand_id", ids.alias("ids"), F.size("evidence").alias("n_evidence"))


@query("top_score", _AUDIT + "SELECT doc_id, cand_id, round(top, 6) AS top_score FROM inv")
def _(spark, sf):
    return audit(spark, sf, flagged_only=True).investigations.select("doc_id", "cand_id", F.round(I.top_score(F.col("evidence")), 6).alias("top_score"))


@query("verdict_policy", _AUDIT + "SELECT doc_id, cand_id, verdict, explanation, rewrite, confidence, needs_human_review, n_occ AS occurrences FROM inv")
def _(spark, sf):
    return audit(spark, sf, flagged_only=True).investigations.select(
        "doc_id", "cand_id", "verdict", "explanation", "rewrite", "confidence", "needs_human_review", F.size("occurrences").alias("occurrences")
    )


@query(
    "investigation_stats",
    _AUDIT + "SELECT doc_id, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (needs_human_review) AS needs_human_review, CAST(2 * count(*) AS BIGINT) AS total_llm_calls, count(*) AS investigations FROM inv GROUP BY doc_id",
)
def _(spark, sf):
    return I.investigation_stats(audit(spark, sf, flagged_only=True).investigations)


_PROMPT_SQL = """
occ AS (SELECT doc_id, cand_idx, CAST(split_part(o, '-', 1) AS INTEGER) AS o0, CAST(split_part(o, '-', 2) AS INTEGER) AS o1 FROM (SELECT doc_id, cand_idx, unnest(string_split(occurrences, ',')) AS o FROM cands))"""


@query("investigation_prompt")
def _(spark, sf):
    read = read_once(spark, sf)
    cands = C.candidates_of(read.audited)
    context = C.candidate_context(cands, read.hits)
    return I.investigation_prompts(context, I.corpus_evidence(cands, evidence_vectors(spark, sf)))


# judged rows from the events table: some technical, some weak, some without any evidence
_JUDGED_SQL = """jd AS (SELECT user_id AS doc_id, event_id AS cand_idx, CASE event_type WHEN 'error' THEN 'Master key' ELSE event_type END AS quote, event_type AS category, 'r ' || event_type AS reason,
  event_id % 3 <> 0 AS has_ev, CASE WHEN event_id % 3 <> 0 THEN (value % 80) / 100 ELSE 0.0::DOUBLE END AS top FROM events),
pol AS (SELECT *, contains(lower(quote), 'master') AS tech, NOT contains(lower(quote), 'master') AND top < 0.3 AS esc FROM jd),
fin AS (SELECT *, CASE WHEN tech THEN 'rejected' ELSE 'confirmed' END AS verdict, CASE WHEN tech THEN 'technical usage in context' WHEN top >= 0.3 THEN 'corroborated by retrieved corpus evidence [1]' ELSE 'weak evidence' END AS explanation,
  CASE WHEN tech THEN 'medium' WHEN top >= 0.5 THEN 'high' WHEN top >= 0.3 THEN 'medium' ELSE 'low' END AS confidence, esc AS review FROM pol)"""


def judged(spark, sf, live=False):
    t, i = F.col("event_type"), F.col("event_id")
    item = F.struct(
        F.lit(1).alias("n"), F.lit("e1").alias("id"), F.lit("text").alias("text"), ((F.col("value") % 80) / 100).alias("score"),
        F.struct(*[F.lit(x).alias(n) for n, x in (("source", "s"), ("doc_id", "d"), ("title", "t"), ("year", "2020"), ("url", "u"))]).alias("metadata"),
    )
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), i.alias("cand_idx"), F.concat(F.lit("cand"), i.cast("string")).alias("cand_id"),
        F.when(t == "error", "Master key").otherwise(t).alias("quote"), t.alias("category"), F.concat(F.lit("r "), t).alias("reason"),
        F.when(i % 3 != 0, F.array(item)).otherwise(F.array().cast(I.EVIDENCE)).cast(I.EVIDENCE).alias("evidence"),
    )
    return I.verdict_policy(rows, RULES, live_available=live)


@query(
    "escalation",
    O.with_(_JUDGED_SQL)
    + """SELECT doc_id, cand_idx, esc AS escalated, CASE WHEN esc AND doc_id % 2 = 0 THEN 'medium' ELSE confidence END AS confidence, CAST(has_ev::INT + (esc AND doc_id % 2 = 0)::INT AS INTEGER) AS n_evidence FROM fin""",
)
def _(spark, sf):
    j = judged(spark, sf, live=True)
    item = F.struct(
        F.lit(1).alias("n"), F.lit("live_1").alias("id"), F.lit("live text").alias("text"), F.lit(0.4).alias("score"),
        F.struct(*[F.lit(x).alias(n) for n, x in (("source", "l"), ("doc_id", "d"), ("title", "t"), ("year", "2021"), ("url", "u"))]).alias("metadata"),
    )
    live = j.filter(F.col("doc_id") % 2 == 0).select("doc_id", "cand_id", F.array(item).cast(I.EVIDENCE).alias("evidence"))
    return I.escalate(j, live, RULES).select("doc_id", "cand_idx", "escalated", "confidence", F.size("evidence").alias("n_evidence"))


_LIVE = [{"request_id": i, "phrases": [], "any_of": [r.word], "min_year": None} for i, r in enumerate(RULES)]
_LIVE_SQL = f"""lv AS (SELECT query AS word, max(score) AS live_top, count(*) AS n_live FROM ladder GROUP BY query),
esc AS (SELECT i.doc_id, i.cand_id, i.confidence = 'low' AS escalated, i.verdict, i.n_ev, l.n_live, greatest(i.top, CASE WHEN i.confidence = 'low' THEN l.live_top END) AS top, i.confidence
  FROM inv i LEFT JOIN lv l ON l.word = lower(i.quote))"""


@query(
    "live_escalation",
    O.with_(*O.AUDIT, _INV_SQL, _ladder_sql(_LIVE), _LIVE_SQL)
    + f"""SELECT doc_id, cand_id, escalated, verdict, CAST(n_ev + CASE WHEN escalated THEN coalesce(n_live, 0) ELSE 0 END AS INTEGER) AS n_evidence, round(top, 6) AS top_score,
  CASE WHEN verdict = 'rejected' THEN 'medium' WHEN top >= {POLICY.strong} THEN 'high' WHEN top >= {POLICY.sufficient} THEN 'medium' ELSE 'low' END AS confidence FROM esc""",
)
def _(spark, sf):
    """Weak candidates are searched in the corpus of documents and judged again."""
    # neither the context of a candidate nor where else it is written is shown
    narrow = C.audit_documents(documents(spark, sf), RULES, window_tokens=WINDOW_TOKENS, expand=False, context=False, flagged_only=True)
    found = C.candidates_of(cut_lineage(narrow))
    live = I.live_search(found, ladder_corpus(spark, sf))
    out = I.investigate(found, evidence_vectors(spark, sf), RULES, live=live, policy=POLICY)
    return out.select("doc_id", "cand_id", "escalated", "verdict", F.size("evidence").alias("n_evidence"), F.round("top_score", 6).alias("top_score"), "confidence")


@query(
    "grounding_guard",
    O.with_(_JUDGED_SQL)
    + """SELECT doc_id, cand_idx, CASE WHEN g THEN 'low' ELSE confidence END AS confidence, g OR review AS needs_human_review, explanation || CASE WHEN g THEN ' (no supporting evidence was retrieved)' ELSE '' END AS explanation,
  CAST(CASE WHEN g THEN 3 ELSE 2 END AS INTEGER) AS turns FROM (SELECT *, verdict = 'confirmed' AND NOT has_ev AS g FROM fin)""",
)
def _(spark, sf):
    return I.grounding_guard(judged(spark, sf).withColumn("turns", F.lit(2))).select(
        "doc_id", "cand_idx", "confidence", "needs_human_review", "explanation", "turns"
    )


@query(
    "forced_finalize",
    O.with_(_JUDGED_SQL)
    + """SELECT doc_id, cand_idx, f AS forced, CASE WHEN f THEN 'confirmed' ELSE verdict END AS verdict, CASE WHEN f THEN 'low' ELSE confidence END AS confidence, f OR review AS needs_human_review,
  CASE WHEN f THEN reason || ' (verification incomplete: investigator hit its turn limit)' ELSE explanation END AS explanation FROM (SELECT *, cand_idx % 4 = 3 AS f FROM fin)""",
)
def _(spark, sf):
    j = judged(spark, sf).withColumn("turns", F.lit(4)).withColumn("finalized", F.col("cand_idx") % 4 != 3)
    return I.forced_finalize(j).select("doc_id", "cand_idx", "forced", "verdict", "confidence", "needs_human_review", "explanation")


@query(
    "finalize_normalize",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'confirmed' ELSE 'rejected' END AS verdict, CASE event_type WHEN 'view' THEN 'biased' ELSE 'potentially-offensive' END AS category,
  CASE WHEN user_id % 2 = 0 THEN 'factually-incorrect' END AS secondary_category, CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM events""",
)
def _(spark, sf):
    t, u = F.col("event_type"), F.col("user_id")
    raw = table(spark, sf, "events").select(
        "event_id", F.when(t == "click", "confirmed").otherwise(t).alias("verdict"), F.when(t == "view", "Biased").otherwise(F.lit(None).cast("string")).alias("category"),
        F.when(u % 2 == 0, "Factually Incorrect").otherwise("").alias("secondary_category"), F.when(u % 3 == 0, "high").otherwise("certain").alias("confidence"),
        F.lit(None).cast("boolean").alias("needs_human_review"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("rewrite"),
    )
    return I.finalize_normalize(raw).select("event_id", "verdict", "category", "secondary_category", "confidence")


@query(
    "action_log",
    O.with_(_JUDGED_SQL)
    + """SELECT doc_id, cand_idx, 'corpus_search' || CASE WHEN esc THEN ',live_search' ELSE '' END || CASE WHEN verdict = 'confirmed' AND NOT has_ev THEN ',premature_finalize' ELSE '' END || ',finalize' AS actions FROM fin""",
)
def _(spark, sf):
    j = judged(spark, sf, live=True)
    e = j.withColumn("escalated", F.col("action") == "live_search").withColumn("turns", F.when(F.col("escalated"), 3).otherwise(2))
    g = I.grounding_guard(e)
    return g.select("doc_id", "cand_idx", F.array_join(I.action_log(F.col("escalated"), F.col("bounced")), ",").alias("actions"))


@query(
    "single_span_why",
    f"""WITH q AS (SELECT event_id, 'potentially-offensive: ' || event_type AS query FROM events), d AS (SELECT DISTINCT query FROM q), v AS (SELECT query, {hash_sql('query')} AS v FROM d),
s AS (SELECT query, max(list_cosine_similarity(v, embedding::DOUBLE[])) AS top FROM v CROSS JOIN embeddings GROUP BY query)
SELECT event_id, round(top, 6) AS top_score, CASE WHEN top >= 0.5 THEN 'high' WHEN top >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM q JOIN s USING (query)""",
)
def _(spark, sf):
    spans = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("cand_id"), F.col("event_type").alias("quote"), F.lit("").alias("reason"),
        F.array().cast("array<struct<char_start:int,char_end:int>>").alias("occurrences"),
    )
    out = I.investigate_spans(spans, evidence_vectors(spark, sf), RULES)
    return out.select(F.col("cand_id").alias("event_id"), F.round("top_score", 6).alias("top_score"), "confidence")


# ---- consolidation ---------------------------------------------------------------------------------


@query("retract_first_low", _AUDIT + "SELECT doc_id, cand_id, retracted FROM decided")
def _(spark, sf):
    return audit(spark, sf, flagged_only=True).decided.select("doc_id", "cand_id", "retracted")


@query("patterns_by_category", _AUDIT + "SELECT doc_id, 'recurring ' || category || ' phrasing' AS framing, category, finding_ids FROM pats")
def _(spark, sf):
    return audit(spark, sf, flagged_only=True).patterns.select("doc_id", "framing", "category", F.array_join("finding_ids", ",").alias("finding_ids"))


@query(
    "confirmed_only",
    _AUDIT + "SELECT c.doc_id, count(i.doc_id) AS confirmed, count(*) FILTER (needs_human_review) AS needs_review, count(i.doc_id) = 0 AS skipped FROM capped c LEFT JOIN decided i USING (doc_id) GROUP BY c.doc_id",
)
def _(spark, sf):
    a = audit(spark, sf)
    return K.consolidation_context(a.audited, a.investigations).select("doc_id", "confirmed", "needs_review", "skipped")


@query(
    "finding_compact",
    _AUDIT
    + """SELECT i.doc_id, i.cand_id, i.category, i.confidence, i.n_occ AS occurrences, i.quote, (SELECT string_agg('Evidence ' || vec_id, '; ' ORDER BY n) FROM ev WHERE ev.query = i.query AND n <= 2) AS titles FROM decided i""",
)
def _(spark, sf):
    return K.finding_compact(audit(spark, sf, flagged_only=True).investigations).select(
        "doc_id", "cand_id", "category", "confidence", "occurrences", "quote", F.array_join("evidence_titles", "; ").alias("titles")
    )


@query(
    "severity_order",
    _AUDIT
    + """SELECT doc_id, cand_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE category WHEN 'exclusionary' THEN 0 ELSE 1 END, cand_idx) AS INTEGER) AS severity_pos FROM decided WHERE NOT retracted""",
)
def _(spark, sf):
    return K.severity_order(audit(spark, sf, flagged_only=True).decided).select("doc_id", "cand_id", "severity_pos")


# replies with unknown ids, ids on both lists and ids on neither
_CONS_SQL = """cf AS (SELECT user_id AS doc_id, event_id AS cand_idx, 'cand' || event_id AS cand_id FROM events),
kp AS (SELECT user_id AS doc_id, -event_id AS pos, 'cand' || event_id AS cand_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, 'bogus' || event_id FROM events WHERE event_id % 7 = 0),
rt AS (SELECT user_id AS doc_id, event_id AS pos, 'cand' || event_id AS cand_id, event_type AS rationale FROM events WHERE event_id % 6 = 0 OR event_id % 5 = 0),
dc AS (SELECT c.doc_id, c.cand_id, r.cand_id IS NOT NULL AS retracted, r.rationale, CASE WHEN r.cand_id IS NOT NULL THEN 2 WHEN k.cand_id IS NOT NULL THEN 0 ELSE 1 END AS grp, CASE WHEN r.cand_id IS NOT NULL THEN r.pos WHEN k.cand_id IS NOT NULL THEN k.pos ELSE c.cand_idx END AS pos
  FROM cf c LEFT JOIN rt r ON r.doc_id = c.doc_id AND r.cand_id = c.cand_id LEFT JOIN kp k ON k.doc_id = c.doc_id AND k.cand_id = c.cand_id)"""


def _cons(spark, sf):
    e, i, u = table(spark, sf, "events"), F.col("event_id"), F.col("user_id").alias("doc_id")
    cid = F.concat(F.lit("cand"), i.cast("string")).alias("cand_id")
    confirmed = e.select(u, i.alias("cand_idx"), cid)
    kept = e.filter(i % 2 == 0).select(u, (-i).alias("pos"), cid).unionByName(
        e.filter(i % 7 == 0).select(u, i.alias("pos"), F.concat(F.lit("bogus"), i.cast("string")).alias("cand_id"))
    )
    gone = e.filter((i % 6 == 0) | (i % 5 == 0)).select(u, i.alias("pos"), cid, F.col("event_type").alias("rationale"))
    return confirmed, K.consolidation_integrity(confirmed, kept, gone)


@query(
    "consolidation_integrity",
    O.with_(_CONS_SQL) + "SELECT doc_id, cand_id, retracted, rationale, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, pos, cand_id) AS INTEGER) AS final_pos FROM dc",
)
def _(spark, sf):
    return _cons(spark, sf)[1]


@query(
    "keep_all_on_parse_failure",
    O.with_(_CONS_SQL)
    + "SELECT doc_id, cand_id, doc_id % 4 = 0 AS parse_failed, CASE WHEN doc_id % 4 = 0 THEN false ELSE retracted END AS retracted FROM dc",
)
def _(spark, sf):
    confirmed, decisions = _cons(spark, sf)
    replies = confirmed.select("doc_id", (F.col("doc_id") % 4 == 0).alias("parse_failed"))
    return K.keep_all_on_parse_failure(confirmed, replies, decisions).select("doc_id", "cand_id", "parse_failed", "retracted")


@query(
    "pattern_integrity",
    """SELECT user_id AS doc_id, event_type AS framing, string_agg('cand' || event_id, ',' ORDER BY event_id) AS finding_ids FROM events WHERE event_id % 3 <> 0 GROUP BY ALL""",
)
def _(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    cid = F.concat(F.lit("cand"), i.cast("string"))
    patterns = e.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("framing")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", cid.alias("c")))), lambda s: s["c"]).alias("finding_ids")
    )
    patterns = patterns.withColumn("pattern_ord", F.xxhash64("framing")).withColumn("category", F.lit(None).cast("string"))
    confirmed = e.filter(i % 3 != 0).select(F.col("user_id").alias("doc_id"), cid.alias("cand_id"))
    return K.pattern_integrity(patterns, confirmed).select("doc_id", "framing", F.array_join("finding_ids", ",").alias("finding_ids"))


# ---- report ------------------------------------------------------------------------------------------


@query("evidence_shape", _AUDIT + "SELECT i.doc_id, i.cand_id, e.n, 'Evidence ' || e.vec_id AS title, CAST(2000 + e.label AS VARCHAR) AS year, 'evidence text ' || e.vec_id AS snippet, round(e.score, 6) AS score FROM inv i JOIN ev e USING (query)")
def _(spark, sf):
    inv = audit(spark, sf, flagged_only=True).investigations
    rows = inv.select("doc_id", "cand_id", F.posexplode(R.evidence_shape(F.col("evidence"))).alias("p", "e"))
    return rows.select("doc_id", "cand_id", (F.col("p") + 1).alias("n"), "e.title", "e.year", "e.snippet", F.round("e.score", 6).alias("score"))


@query(
    "findings",
    _AUDIT
    + "SELECT doc_id, cand_id AS id, quote, char_start || '-' || char_end AS offsets, n_occ AS occurrences, category, explanation, rewrite, confidence, n_ev > 0 AS grounded, needs_human_review, retracted, CASE WHEN retracted THEN 'weak grounding — likely false positive' END AS retraction_rationale FROM decided",
)
def _(spark, sf):
    f = audit(spark, sf, flagged_only=True).findings
    return f.select(
        "doc_id", "id", "quote", F.array_join(F.col("offsets").cast("array<string>"), "-").alias("offsets"), "occurrences", "category", "explanation", "rewrite",
        "confidence", "grounded", "needs_human_review", "retracted", "retraction_rationale",
    )


@query("findings_order", _AUDIT + "SELECT doc_id, cand_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY retracted, cand_idx) AS INTEGER) AS finding_no FROM decided")
def _(spark, sf):
    return R.findings_order(audit(spark, sf, flagged_only=True).findings).select("doc_id", "id", "finding_no")


@query("report_summary", _AUDIT + "SELECT * FROM summ")
def _(spark, sf):
    return audit(spark, sf).summary


@query("report_validate", _AUDIT + "SELECT doc_id, cand_id AS id, 'confidence' AS rule FROM decided WHERE confidence = 'low'")
def _(spark, sf):
    """Low confidence is renamed on purpose, so the validator has something to find."""
    f = audit(spark, sf, flagged_only=True).findings
    return R.report_violations(f.withColumn("confidence", F.when(F.col("confidence") == "low", "lowish").otherwise(F.col("confidence"))))


@query(
    "report_document_validate",
    _AUDIT + "SELECT doc_id, unnest(CASE WHEN confirmed = 0 THEN ['version', 'summary:windows'] ELSE [] END) AS rule FROM summ",
)
def _(spark, sf):
    """Reports without findings lose a count and name another version, so the validator has something to find."""
    a = audit(spark, sf)
    j = R.report_json(a.summary, a.findings, a.patterns)
    spoilt = F.replace(F.replace("report", F.lit('"version":"2.0"'), F.lit('"version":"1.0"')), F.lit('"windows":'), F.lit('"panes":'))
    bare = F.json_array_length(F.get_json_object("report", "$.findings")) == 0
    return R.document_violations(j.withColumn("report", F.when(bare, spoilt).otherwise(F.col("report"))))


_MD_SQL = f"""
fo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY retracted, cand_idx) AS no FROM decided),
mk AS (SELECT doc_id, string_agg(no || '. `' || quote || '`: ' || category || ' (' || confidence || ' confidence' || CASE WHEN needs_human_review THEN '; a person should look at it' ELSE '' END || ')' || chr(10)
  || '   - reason: ' || explanation || chr(10) || '   - better: ' || rewrite || chr(10) || md, '' ORDER BY no) AS kept FROM fo WHERE NOT retracted GROUP BY doc_id),
mg AS (SELECT doc_id, string_agg('- `' || quote || '` (' || category || '): weak grounding — likely false positive' || chr(10), '' ORDER BY no) AS gone FROM fo WHERE retracted GROUP BY doc_id),
mp AS (SELECT doc_id, string_agg('- recurring ' || category || ' phrasing, ' || n || ' times (' || category || ')' || chr(10), '' ORDER BY pattern_ord) AS pt FROM pats GROUP BY doc_id),
mh AS (SELECT doc_id, '{R.REPORT_TITLE}' || chr(10) || chr(10) || '| measure | count |' || chr(10) || '| --- | --- |' || chr(10)
  || {" || ".join(f"'| {c.replace('_', ' ')} | ' || {c} || ' |' || chr(10)" for c in R.COUNTS)} AS head FROM summ)"""


_MARKDOWN = """SELECT mh.doc_id, head || coalesce(chr(10) || '## Findings' || chr(10) || chr(10) || kept, chr(10) || 'Nothing was confirmed.' || chr(10))
  || coalesce(chr(10) || '## Patterns' || chr(10) || chr(10) || pt, '') || coalesce(chr(10) || '## Withdrawn' || chr(10) || chr(10) || gone, '') AS markdown
  FROM mh LEFT JOIN mk USING (doc_id) LEFT JOIN mg USING (doc_id) LEFT JOIN mp USING (doc_id)"""


@query("report_markdown", O.with_(*O.AUDIT, _INV_SQL, _MD_SQL) + _MARKDOWN)
def _(spark, sf):
    a = audit(spark, sf)
    return R.report_markdown(a.summary, a.findings, a.patterns)


@query(
    "report_json_sink",
    _AUDIT + "SELECT s.doc_id, '2.0' AS version, s.confirmed, count(d.doc_id) AS n_findings FROM summ s LEFT JOIN decided d USING (doc_id) GROUP BY ALL",
)
def _(spark, sf):
    a = audit(spark, sf)
    j = R.report_json(a.summary, a.findings, a.patterns)
    return j.select(
        "doc_id", F.get_json_object("report", "$.version").alias("version"), F.get_json_object("report", "$.summary.confirmed").cast("bigint").alias("confirmed"),
        F.json_array_length(F.get_json_object("report", "$.findings")).cast("bigint").alias("n_findings"),
    )


# ---- evaluation -----------------------------------------------------------------------------------------

_HIT_DOCS = f"""hd AS (SELECT doc_id, count(*) AS n FROM hits WHERE category IN ('ableist', 'potentially-offensive') GROUP BY doc_id),
scored AS (SELECT l.doc_id, coalesce(h.n, 0) AS n, toxic = 1 AS expected, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'biased' ELSE 'outdated' END END AS expected_category FROM labels l LEFT JOIN hd h USING (doc_id))"""
_EVAL = O.with_(O.DOCS, O.hits(), _HIT_DOCS)


def scored(spark, sf):
    n = hits(spark, sf).filter(F.col("category").isin("ableist", "potentially-offensive")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "labels").join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    toxic = F.col("toxic") == 1
    return rows.select(
        "doc_id", "n", (F.col("n") > 0).alias("predicted"), toxic.alias("expected"),
        F.when(toxic, F.when(F.col("quality") == 1, "biased").otherwise("outdated")).alias("expected_category"),
    )


def _prf_sql(source: str, extra: str = "") -> str:
    return f"""SELECT {extra}tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1
  FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM {source})"""


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "binary_prf",
    _EVAL
    + _prf_sql("(SELECT count(*) FILTER (n > 0 AND expected) AS tp, count(*) FILTER (n > 0 AND NOT expected) AS fp, count(*) FILTER (n = 0 AND expected) AS fn, count(*) FILTER (n = 0 AND NOT expected) AS tn FROM scored)", "tn, "),
)
def _(spark, sf):
    return rounded(E.binary_prf(scored(spark, sf)))


@query("per_label_breakdown", _EVAL + "SELECT coalesce(expected_category, 'Correct') AS label, count(*) AS n, count(*) FILTER (n > 0) AS flagged FROM scored GROUP BY 1")
def _(spark, sf):
    return E.per_label_breakdown(scored(spark, sf).drop("n"))


@query(
    "accuracy_recall",
    _EVAL
    + """SELECT *, round((tp + tn)::DOUBLE / n, 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS flag_recall, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS clean_precision FROM
  (SELECT count(*) AS n, count(*) FILTER (n > 0 AND expected) AS tp, count(*) FILTER (n = 0 AND expected) AS fn, count(*) FILTER (n = 0 AND NOT expected) AS tn, count(*) FILTER (n > 0 AND NOT expected) AS fp FROM scored)""",
)
def _(spark, sf):
    label = F.when(F.col("n") == 0, "skip").when(F.col("n") == 1, "ask").otherwise("flag")
    return rounded(E.accuracy_recall(scored(spark, sf).select(label.alias("label"), "expected")))


@query("label_normalize", "SELECT p_partkey, replace(lower(trim(' ' || p_name || ' ')), ' ', '-') AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.normalize_gold_label(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("label"))


@query("span_overlap", "SELECT doc_id, greatest(0, least(n_chars, doc_id * 2 + 50) - greatest(n_chars // 2, doc_id * 2)) AS chars FROM documents")
def _(spark, sf):
    n, d = F.col("n_chars"), F.col("doc_id")
    half = F.floor(n / 2)
    return table(spark, sf, "documents").select("doc_id", overlap_chars(half, n, d * 2, d * 2 + 50).alias("chars"))


_GOLD_SQL = """gold AS (SELECT d.doc_id, b.item_id AS gold_idx, strpos(d.text, replace(b.text, chr(10), chr(10) || chr(10))) - 1 AS g0, strpos(d.text, replace(b.text, chr(10), chr(10) || chr(10))) - 1 + length(replace(b.text, chr(10), chr(10) || chr(10))) AS g1,
  CASE b.item_id % 3 WHEN 0 THEN ['correct'] WHEN 1 THEN ['biased', 'outdated'] ELSE ['potentially-offensive', 'correct'] END AS labels, b.item_id % 3 <> 0 AS is_problem FROM docs d JOIN benchmark b ON strpos(d.text, replace(b.text, chr(10), chr(10) || chr(10))) > 0),
pred AS (SELECT doc_id, char_start AS pred_idx, greatest(0, char_start - 100) AS p0, char_end + 100 AS p1, category FROM hits),
pr AS (SELECT p.doc_id, p.pred_idx, g.gold_idx, g.labels, g.is_problem, (least(p1, g1) - greatest(p0, g0))::DOUBLE / (g1 - g0) AS frac FROM pred p JOIN gold g ON g.doc_id = p.doc_id AND p0 < g1 AND g0 < p1),
bm AS (SELECT * FROM pr WHERE frac >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, pred_idx ORDER BY frac DESC, gold_idx) = 1),
oc AS (SELECT p.doc_id, p.pred_idx, p.category AS pred_label, m.gold_idx, m.frac, CASE WHEN m.gold_idx IS NULL THEN 'unmatched_fp' WHEN NOT m.is_problem THEN 'fp_on_correct' WHEN list_contains(m.labels, p.category) THEN 'tp' ELSE 'label_miss' END AS outcome
  FROM pred p LEFT JOIN bm m ON m.doc_id = p.doc_id AND m.pred_idx = p.pred_idx),
gl AS (SELECT doc_id, gold_idx, label FROM (SELECT doc_id, gold_idx, unnest(labels) AS label FROM gold) WHERE label <> 'correct')"""
_SPAN = O.with_(O.DOCS, O.hits(), _GOLD_SQL)


def gold(spark, sf):
    docs = guarded(spark, sf)
    items = table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    m = F.col("gold_idx") % 3
    labels = F.when(m == 0, F.array(F.lit("Correct"))).when(m == 1, F.array(F.lit("Biased"), F.lit("outdated"))).otherwise(
        F.array(F.lit("Potentially Offensive"), F.lit("correct"))
    )
    found = place_passages(docs, items).withColumnRenamed("item_id", "gold_idx")
    return found.select("doc_id", "gold_idx", "char_start", "char_end", labels.alias("labels"))


def predictions(spark, sf):
    return hits(spark, sf).select(
        "doc_id", F.col("char_start").alias("pred_idx"), F.greatest(F.lit(0), F.col("char_start") - 100).alias("char_start"),
        (F.col("char_end") + 100).alias("char_end"), "category",
    )


def outcomes(spark, sf, spans=None):
    """Scored predictions; several metrics read these narrow rows, so the texts are scanned once."""
    return cut_lineage(E.match_outcome(E.best_gold_match(predictions(spark, sf), gold(spark, sf) if spans is None else spans)))


def scored_gold(spark, sf):
    """Scored predictions and the gold spans, which are placed in the texts once."""
    spans = cut_lineage(gold(spark, sf))
    return outcomes(spark, sf, spans), spans


@query("best_gold_match", _SPAN + "SELECT doc_id, pred_idx, gold_idx, round(frac, 6) AS frac FROM oc")
def _(spark, sf):
    return E.best_gold_match(predictions(spark, sf), gold(spark, sf)).select("doc_id", "pred_idx", "gold_idx", F.round("frac", 6).alias("frac"))


@query("match_outcome", _SPAN + "SELECT doc_id, pred_idx, pred_label, outcome FROM oc")
def _(spark, sf):
    return outcomes(spark, sf).select("doc_id", "pred_idx", "pred_label", "outcome")


_PER_LABEL = """pl AS (SELECT coalesce(a.label, b.label) AS label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT pred_label AS label, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome <> 'tp') AS fp FROM oc GROUP BY 1) a
  FULL JOIN (SELECT label, count(*) AS fn FROM gl WHERE (doc_id, gold_idx) NOT IN (SELECT (doc_id, gold_idx) FROM oc WHERE outcome = 'tp') GROUP BY 1) b ON a.label = b.label)"""


@query("per_label_prf", O.with_(O.DOCS, O.hits(), _GOLD_SQL, _PER_LABEL) + _prf_sql("pl", "label, "))
def _(spark, sf):
    return rounded(E.per_label_prf(*scored_gold(spark, sf)))


@query(
    "micro_prf",
    O.with_(O.DOCS, O.hits(), _GOLD_SQL, _PER_LABEL) + _prf_sql("(SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pl)"),
)
def _(spark, sf):
    return rounded(E.micro_prf(E.per_label_prf(*scored_gold(spark, sf))))


@query(
    "span_detection",
    _SPAN
    + _prf_sql(
        "(SELECT count(*) FILTER (outcome IN ('tp', 'label_miss')) AS tp, count(*) FILTER (outcome NOT IN ('tp', 'label_miss')) AS fp, (SELECT count(*) FROM gold g WHERE is_problem AND NOT EXISTS (SELECT 1 FROM oc o WHERE o.doc_id = g.doc_id AND o.gold_idx = g.gold_idx AND outcome IN ('tp', 'label_miss'))) AS fn FROM oc)"
    ),
)
def _(spark, sf):
    return rounded(E.span_detection(*scored_gold(spark, sf)))


@query(
    "gold_label_recall",
    _SPAN
    + "SELECT label, count(s.d) AS detected, count(*) AS total, round(count(s.d)::DOUBLE / count(*), 6) AS recall FROM gl LEFT JOIN (SELECT DISTINCT doc_id AS d, gold_idx AS g FROM oc WHERE outcome IN ('tp', 'label_miss')) s ON s.d = gl.doc_id AND s.g = gl.gold_idx GROUP BY label",
)
def _(spark, sf):
    return rounded(E.gold_label_recall(*scored_gold(spark, sf)))


@query(
    "fp_on_correct_rate",
    _SPAN + "SELECT count(*) FILTER (outcome = 'fp_on_correct') AS fp_on_correct, count(*) AS n_predicted, round(count(*) FILTER (outcome = 'fp_on_correct')::DOUBLE / count(*), 6) AS rate FROM oc",
)
def _(spark, sf):
    return rounded(E.fp_on_correct_rate(outcomes(spark, sf)))


@query(
    "score_overview",
    _SPAN
    + "SELECT count(*) FILTER (outcome = 'label_miss') AS label_miss, count(*) FILTER (outcome = 'unmatched_fp') AS unmatched_fp, count(*) AS n_predicted, (SELECT count(*) FROM gold WHERE is_problem) AS n_gold_problem_spans FROM oc",
)
def _(spark, sf):
    return E.score_overview(*scored_gold(spark, sf))


def _predicted_sql() -> str:
    ctes, parts = [], []
    for i, r in enumerate(RULES):
        ctes.append(O.matches(f"x{i}", f"(SELECT d.doc_id, d.ft FROM docs d SEMI JOIN (SELECT doc_id FROM decided WHERE lower(quote) = '{r.word}' AND NOT retracted) USING (doc_id)) z{i}", "ft", f"(?i){r.word}"))
        parts.append(f"SELECT x.doc_id, d.category, x.char_start, x.char_end FROM x{i} x JOIN decided d ON d.doc_id = x.doc_id AND lower(d.quote) = '{r.word}'")
    return O.with_(*O.AUDIT, _INV_SQL, *ctes) + " UNION ALL ".join(parts)


@query("predicted_spans", _predicted_sql())
def _(spark, sf):
    return E.predicted_spans(audit(spark, sf, flagged_only=True).decided).select("doc_id", "category", "char_start", "char_end")


_BASE_HIT = f"SELECT doc_id, chunk_idx FROM cl_x WHERE regexp_matches(ft, '{O.alternation([e[0] for e in O.LEXICON])}')"


@query(
    "baseline_audit",
    O.with_(O.RAW, _CHUNK_SQL, O.rules(), _CLASSIFY_SQL)
    + f"SELECT c.doc_id, c.chunk_idx, c.text AS span, c.flag_category AS category, c.reason, 'medium' AS confidence FROM classified c SEMI JOIN ({_BASE_HIT}) h ON h.doc_id = c.doc_id AND h.chunk_idx = c.chunk_idx WHERE label = 'flag'",
)
def _(spark, sf):
    return E.baseline_audit(raw_documents(spark, sf), lexicon(spark), RULES).select("doc_id", "chunk_idx", "span", "category", "reason", "confidence")


@query(
    "control_flow_divergence",
    """WITH a AS (SELECT DISTINCT event_type || ' ' || user_id % 7 AS event FROM events), b AS (SELECT DISTINCT event_type || ' ' || user_id % 11 AS event FROM events WHERE user_id % 3 = 0)
SELECT event, 'agent_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT event, 'shared' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT event, 'baseline_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _(spark, sf):
    e, u = table(spark, sf, "events"), F.col("user_id")
    name = lambda m: F.concat("event_type", F.lit(" "), (u % m).cast("string")).alias("event")
    return E.control_flow_divergence(e.select(name(7)), e.filter(u % 3 == 0).select(name(11)))


@query(
    "parse_failure_warning",
    """SELECT conv_id AS doc_id, count(*) FILTER (conv_id % 4 = 3) AS windows_parse_failed, CASE WHEN count(*) FILTER (conv_id % 4 = 3) > 0 THEN count(*) FILTER (conv_id % 4 = 3) || ' windows returned unparseable output — results are a lower bound.' END AS warning FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    from .catalog_text import replies

    parsed = C.parse_responses(replies(spark, sf))
    return E.parse_failure_warning(parsed.groupBy("doc_id").agg(F.count_if("parse_failed").alias("windows_parse_failed")))


# ---- alignment -------------------------------------------------------------------------------------------

COLOURS = [("biased", 0.9, 0.2, 0.2), ("outdated", 0.3, 0.5, 0.9), ("correct", 0.5, 0.9, 0.4)]

# pages are documents, joined per source; highlights are their blocks, some marked twice
_ALIGN_SQL = f"""
pages_t AS (SELECT s.source AS doc_id, d.doc_id AS page, d.text FROM docs d JOIN documents s USING (doc_id)),
po AS (SELECT doc_id, page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM pages_t),
hl AS (SELECT p.doc_id, p.page, b.block_idx * 10.0 AS y, {O.strip("regexp_replace(b.text, '" + O.WS + "+', ' ', 'g')")} AS text, CASE b.kind WHEN 'heading' THEN 'outdated' WHEN 'list' THEN 'correct' ELSE 'biased' END AS label, b.block_idx, b.char_start, b.char_end
  FROM blocks b JOIN pages_t p ON p.page = b.doc_id)"""
_ALIGN = O.with_(O.DOCS, O.blocks(), _ALIGN_SQL)


def pages(spark, sf):
    """Documents as the pages of their source."""
    rows = raw_documents(spark, sf).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return P.guard_english(P.guard_nonempty(rows))


def highlights(spark, sf):
    """A highlight per block and a second one on every third, from one parse."""
    b = P.parse_blocks(pages(spark, sf)).select("doc_id", "page", F.inline("blocks"))
    red = F.struct(F.lit(0.8).alias("r"), F.lit(0.25).alias("g"), F.lit(0.2).alias("b"))
    blue = F.struct(F.lit(0.35).alias("r"), F.lit(0.5).alias("g"), F.lit(0.95).alias("b"))
    green = F.struct(F.lit(0.49).alias("r"), F.lit(0.94).alias("g"), F.lit(0.4).alias("b"))
    colour = F.when(F.col("kind") == "heading", blue).when(F.col("kind") == "list", green).otherwise(red)
    mark = lambda y, pos, c: F.struct((F.col("block_idx") * 10.0 + y).alias("y"), (F.col("block_idx") * 2 + pos).alias("pos"), c.alias("c"))
    first, again = mark(0, 0, colour), mark(2, 1, green)
    marks = b.select("doc_id", "page", T.collapse_ws(F.col("text")).alias("text"), F.inline(F.when(F.col("block_idx") % 3 == 0, F.array(first, again)).otherwise(F.array(first))))
    return marks.select("doc_id", "page", "y", "pos", "text", "c.r", "c.g", "c.b")


def merged_highlights(spark, sf):
    return A.highlight_merge(A.nearest_label(highlights(spark, sf), COLOURS))


@query(
    "nearest_label",
    _ALIGN + "SELECT label, count(*) AS n FROM (SELECT label FROM hl UNION ALL SELECT 'correct' FROM hl WHERE block_idx % 3 = 0) GROUP BY label",
)
def _(spark, sf):
    return A.nearest_label(highlights(spark, sf), COLOURS).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LABELS = "CASE WHEN block_idx % 3 = 0 AND label <> 'correct' THEN CASE WHEN label = 'biased' THEN 'biased,correct' ELSE 'correct,outdated' END ELSE label END"


@query(
    "highlight_merge",
    _ALIGN + f"SELECT doc_id, page, CAST(block_idx AS INTEGER) AS group_idx, text, {_LABELS} AS labels, CASE WHEN block_idx % 3 = 0 THEN 2 ELSE 1 END AS n_rows FROM hl",
)
def _(spark, sf):
    return merged_highlights(spark, sf).select("doc_id", "page", "group_idx", "text", F.array_join("labels", ",").alias("labels"), "n_rows")


@query("page_offsets", _ALIGN + "SELECT doc_id, page, page_start FROM po")
def _(spark, sf):
    return A.page_offsets(pages(spark, sf), width=200).select("doc_id", "page", "page_start")


def aligned(spark, sf, groups=None):
    p = pages(spark, sf)
    return A.highlight_align(merged_highlights(spark, sf) if groups is None else groups, p, A.page_offsets(p, width=200))


def aligned_notes(spark, sf):
    """Every fourth highlight carries a remark that is not in the page."""
    groups = merged_highlights(spark, sf)
    remark = F.when(F.col("group_idx") % 4 == 1, F.lit(" [added by hand]")).otherwise("")
    return aligned(spark, sf, groups.withColumn("text", F.concat("text", remark)))


@query(
    "highlight_align",
    _ALIGN + "SELECT h.doc_id, h.page, CAST(block_idx AS INTEGER) AS group_idx, page_start + char_start AS char_start, page_start + char_end AS char_end FROM hl h JOIN po ON po.doc_id = h.doc_id AND po.page = h.page",
)
def _(spark, sf):
    return aligned(spark, sf).select("doc_id", "page", "group_idx", "char_start", "char_end")


@query(
    "match_report",
    _ALIGN + "SELECT doc_id, CAST(sum(CASE WHEN block_idx % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN block_idx % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS total, true AS passes FROM hl GROUP BY doc_id",
)
def _(spark, sf):
    return A.match_report(aligned(spark, sf)).select("doc_id", "matched", "total", "passes")


@query(
    "gold_span_order",
    _ALIGN
    + "SELECT h.doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY h.page, block_idx) - 1 AS INTEGER) AS gold_idx, page_start + char_start AS char_start FROM hl h JOIN po ON po.doc_id = h.doc_id AND po.page = h.page",
)
def _(spark, sf):
    return A.gold_spans(aligned(spark, sf)).select("doc_id", "gold_idx", "char_start")


_MARKS = "CASE WHEN block_idx % 3 = 0 THEN 2 ELSE 1 END"


@query(
    "match_gate",
    _ALIGN + f"""SELECT doc_id, matched, total, matched / total >= {A.MATCH_GATE} AS passes FROM
  (SELECT doc_id, CAST(sum(CASE WHEN block_idx % 4 = 1 THEN 0 ELSE {_MARKS} END) AS BIGINT) AS matched, CAST(sum({_MARKS}) AS BIGINT) AS total FROM hl GROUP BY doc_id)""",
)
def _(spark, sf):
    return A.match_report(aligned_notes(spark, sf)).select("doc_id", "matched", "total", "passes")


@query("unmatched_highlights", _ALIGN + "SELECT doc_id, page, CAST(block_idx AS INTEGER) AS group_idx, text || ' [added by hand]' AS text FROM hl WHERE block_idx % 4 = 1")
def _(spark, sf):
    return A.unmatched_highlights(aligned_notes(spark, sf))


@query(
    "label_histogram",
    _ALIGN + f"SELECT label, count(*) AS n FROM (SELECT unnest(string_split({_LABELS}, ',')) AS label FROM hl WHERE block_idx % 4 <> 1) GROUP BY label",
)
def _(spark, sf):
    return A.label_histogram(aligned_notes(spark, sf))
