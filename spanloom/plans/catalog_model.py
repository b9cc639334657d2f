"""Registered queries: the audit with a model function in place of the rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions.sizes import cut_lineage
from ..operators import candidates as C
from ..operators import match as M
from ..operators import turns as U
from . import oracle as O
from .audit import ask_model
from .catalog_tables import _ladder_sql, ladder_corpus
from .catalog_text import _CONTEXT_SQL, read_once
from .inputs import RULES, WINDOW_TOKENS, documents, evidence_vectors, lexicon
from .registry import query

# The stand-in model quotes the first match of each rule word in a passage. Every third passage length also brings a quote that
# stands nowhere; every fifth is answered without JSON. Terms of up to three letters are called clean, one term is left out.
_UNHEARD, _LEFT_OUT = "words that no text has", "of the"
_PASSAGE = re.compile(r"(?s)<passage>\n(.*)\n</passage>\n")
_HINT = re.compile(r"(?m)^\d+\. (.+?) \[")


def complete(prompts: list[str]) -> list[str]:
    return [_reply(p) for p in prompts]


def _reply(prompt: str) -> str:
    head, passage = prompt[: prompt.index("<passage>")], _PASSAGE.search(prompt)[1]
    if len(passage) % 5 == 0:
        return "I would rather not {say}."
    said = []
    for r in RULES:
        m = re.search(rf"\b{r.word}\b", passage, re.I)
        if m:
            said.append({"quote": m[0], "category": r.category.title(), "reason": f"contains: {r.word}", "lexicon_backed": True})
    if len(passage) % 3 == 0:
        said.append({"quote": _UNHEARD, "category": "biased"})
    verdicts = [{"term": t, "verdict": "clean" if len(t) <= 3 else "flag"} for t in _HINT.findall(head) if t != _LEFT_OUT]
    return "```json\n" + json.dumps({"candidates": said, "hint_verdicts": verdicts}) + "\n```"


_MODEL_SQL = f"""asked AS (SELECT doc_id, window_idx, length(text) % 5 = 0 AS failed, length(text) % 3 = 0 AND length(text) % 5 <> 0 AS unheard FROM windows),
mverified AS (SELECT v.* FROM verified v JOIN asked a ON a.doc_id = v.doc_id AND a.window_idx = v.window_idx WHERE NOT failed),
mdeduped AS (SELECT * FROM mverified WHERE accepted QUALIFY row_number() OVER (PARTITION BY doc_id, char_start, char_end ORDER BY window_idx, pos) = 1),
mkeyed AS (SELECT *, lower({O.strip(f"regexp_replace(quote, '{O.WS}+', ' ', 'g')")}) AS quote_key FROM mdeduped),
mgrouped AS (SELECT doc_id, quote_key, arg_min(category, char_start) AS category, min(char_start) AS char_start, count(*) AS n_occ, min(window_idx * 1000 + pos) AS first_seen
  FROM mkeyed GROUP BY doc_id, quote_key)"""


def _asked(spark, sf):
    return ask_model(documents(spark, sf), lexicon(spark), complete, window_tokens=WINDOW_TOKENS)


def _audited(spark, sf, parsed):
    return cut_lineage(C.audit_replies(documents(spark, sf), parsed, window_tokens=WINDOW_TOKENS, expand=False, context=False))


@query(
    "model_audit_stats",
    O.with_(*O.AUDIT, O.hits(), O.HINTS, _MODEL_SQL)
    + """SELECT c.doc_id, c.n_windows AS windows, coalesce(h.n, 0) AS hints, coalesce(v.raw, 0) + a.unheard AS raw_candidates, coalesce(v.dropped, 0) + a.unheard AS dropped_unverified,
  coalesce(k.n, 0) AS candidates, a.failed AS windows_parse_failed
FROM capped c JOIN (SELECT doc_id, count(*) FILTER (failed) AS failed, count(*) FILTER (unheard) AS unheard FROM asked GROUP BY 1) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM hints GROUP BY 1) h USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS raw, count(*) FILTER (NOT accepted) AS dropped FROM mverified GROUP BY 1) v USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM mgrouped GROUP BY 1) k USING (doc_id)""",
)
def _(spark, sf):
    asked = _asked(spark, sf)
    audited = _audited(spark, sf, asked.replies)
    n = asked.hints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hints"))
    return C.audit_stats(audited, C.candidates_of(audited), n)


@query(
    "model_candidates",
    O.with_(*O.AUDIT, _MODEL_SQL)
    + """SELECT doc_id, 'cand' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) - 1)::VARCHAR, 4, '0') AS cand_id, quote_key, category, char_start,
  CAST(n_occ AS INTEGER) AS n_occurrences FROM mgrouped""",
)
def _(spark, sf):
    found = C.candidates_of(_audited(spark, sf, _asked(spark, sf).replies))
    return found.select("doc_id", "cand_id", "quote_key", "category", "char_start", F.size("occurrences").alias("n_occurrences"))


@query(
    "model_hint_verdicts",
    O.with_(*O.AUDIT, O.hits(), O.HINTS, _MODEL_SQL)
    + f"""SELECT h.doc_id, h.window_idx, h.term, CASE WHEN a.failed OR h.term = '{_LEFT_OUT}' OR length(h.term) <= 3 THEN 'clean' ELSE 'flag' END AS verdict,
  a.failed OR h.term = '{_LEFT_OUT}' AS filled FROM hints h JOIN asked a ON a.doc_id = h.doc_id AND a.window_idx = h.window_idx""",
)
def _(spark, sf):
    asked = _asked(spark, sf)
    return M.hint_adjudication(asked.hints, C.reply_verdicts(asked.replies)).select("doc_id", "window_idx", "term", "verdict", "filled")


# The stand-in model of this query fails like the one above, but every second failing passage is read once it is asked again.
def _complete_twice(prompts: list[str]) -> list[str]:
    return [_reply(p.replace("<passage>\n", "<passage>\n ", 1)) if p.endswith(U.REPAIR) and len(_PASSAGE.search(p)[1]) % 2 == 0 else _reply(p) for p in prompts]


@query(
    "model_retry",
    O.with_(*O.AUDIT) + """SELECT doc_id, count(*) FILTER (length(text) % 5 = 0) AS repaired, count(*) FILTER (length(text) % 5 = 0 AND length(text) % 2 = 1) AS failed, count(*) AS windows
FROM windows GROUP BY doc_id""",
)
def _(spark, sf):
    asked = ask_model(documents(spark, sf), lexicon(spark), _complete_twice, window_tokens=WINDOW_TOKENS)
    return asked.replies.groupBy("doc_id").agg(F.count_if("repaired").alias("repaired"), F.count_if("parse_failed").alias("failed"), F.count(F.lit(1)).alias("windows"))


# ---- investigation by a model ----------------------------------------------------------------------

# The stand-in model decides by the phrase and by what was done. Its replies per phrase, in the order of the turns; the last one stands
# for all later turns. Text that is no JSON is sent again when repaired, but for "trash".
_CORPUS = {"action": "corpus_search", "query": "evidence"}
_YES = {"action": "finalize", "verdict": "confirmed", "category": "Biased", "confidence": "high", "explanation": "see [1]"}
_LIVE = [{"action": "live_search", "phrases": ["stupid"], "any_of": [], "min_year": None}, {"action": "live_search", "phrases": [], "any_of": ["license", "trash"], "min_year": 2000}]
_SCRIPT = {
    "he": [_YES, _CORPUS, _YES], "idiot": [_CORPUS, {**_YES, "verdict": "rejected", "confidence": "medium"}], "moron": [_CORPUS],
    "stupid": ["nothing to say", {"action": "think"}, _LIVE[0], _YES], "trash": [{**_CORPUS, "query": ""}, {**_YES, "confidence": "sure"}],
    "worthless": [_LIVE[1], {**_YES, "needs_human_review": True}], "pathetic": [_YES], "disgusting": [{"action": "finalize", "verdict": "rejected"}],
}
_PHRASE = re.compile(r"(?m)^phrase: (.*)$")
_DONE = re.compile(r"(?m)^done: (.*)$")


def _investigator(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        phrase, done = _PHRASE.search(p)[1].lower(), _DONE.search(p)
        script = _SCRIPT[phrase]
        reply = script[min(len(done[1].split(", ")) if done else 0, len(script) - 1)]
        if phrase == "trash" and not p.endswith(U.REPAIR):
            reply = "let me think"
        out.append(reply if isinstance(reply, str) else "Here: " + json.dumps(reply))
    return out


def _turns(spark, sf, **options):
    read = read_once(spark, sf, flagged_only=True)
    context = C.candidate_context(C.candidates_of(read.audited), read.hits)
    return U.investigate_turns(context, evidence_vectors(spark, sf), _investigator, live=ladder_corpus(spark, sf), **options)


_OUTCOMES = """(VALUES
  ('he', 'confirmed', 'biased', 'see [1]', 'high', false, 3, 'premature_finalize,corpus_search,finalize', false, false, 'c'),
  ('idiot', 'rejected', 'biased', 'see [1]', 'medium', false, 2, 'corpus_search,finalize', false, false, 'c'),
  ('moron', 'confirmed', NULL, NULL, 'low', true, 4, 'corpus_search,corpus_search,corpus_search,corpus_search', true, false, 'c'),
  ('stupid', 'confirmed', 'biased', 'see [1]', 'high', false, 4, 'invalid,invalid,live_search,finalize', false, false, '1'),
  ('trash', 'confirmed', 'biased', 'see [1] (no supporting evidence was retrieved)', 'low', true, 3, 'corpus_search,premature_finalize,finalize', false, true, ''),
  ('worthless', 'confirmed', 'biased', 'see [1]', 'high', true, 2, 'live_search,finalize', false, false, '2'),
  ('pathetic', 'confirmed', 'biased', 'see [1] (no supporting evidence was retrieved)', 'low', true, 2, 'premature_finalize,finalize', false, true, ''),
  ('disgusting', 'rejected', 'potentially-offensive', '', 'low', false, 1, 'finalize', false, false, ''))
  o(word, verdict, said_category, said, confidence, needs_human_review, turns, actions, forced, confidence_capped, source)"""
_LIVE_REQUESTS = [{"request_id": i, "phrases": r["phrases"], "any_of": r["any_of"], "min_year": r["min_year"]} for i, r in enumerate(_LIVE, 1)]


@query(
    "model_investigations",
    O.with_(*O.AUDIT, _ladder_sql(_LIVE_REQUESTS))
    + f"""SELECT c.doc_id, 'cand' || lpad(c.cand_idx::VARCHAR, 4, '0') AS cand_id, o.verdict, coalesce(said_category, c.category) AS category,
  CASE WHEN o.forced THEN c.reason || ' (verification incomplete: investigator hit its turn limit)' ELSE said END AS explanation, o.confidence, o.needs_human_review, o.turns, o.actions, o.forced,
  o.confidence_capped, CAST(CASE o.source WHEN 'c' THEN (SELECT least(3, count(DISTINCT label)) FROM embeddings) WHEN '' THEN 0 ELSE (SELECT count(*) FROM ladder WHERE request_id = try_cast(o.source AS INTEGER)) END AS INTEGER) AS n_evidence
FROM cands c JOIN {_OUTCOMES} ON o.word = lower(c.quote)""",
)
def _(spark, sf):
    return _turns(spark, sf).results.select(
        "doc_id", "cand_id", "verdict", "category", "explanation", "confidence", "needs_human_review", "turns", F.array_join("actions", ",").alias("actions"), "forced",
        "confidence_capped", F.size("evidence").alias("n_evidence"),
    )


_TASK_SQL = U.TASK.format(turns=U.MAX_TURNS, live=U.LIVE_ACTION).replace("'", "''")


@query(
    "model_turn_prompts",
    O.with_(*O.AUDIT, O.hits(), _CONTEXT_SQL)
    + f"""SELECT c.doc_id, 'cand' || lpad(c.cand_idx::VARCHAR, 4, '0') AS cand_id, t.turn, md5('{_TASK_SQL}' || chr(10) || 'phrase: ' || c.quote || chr(10) || 'suspected: ' || c.category || ', because ' || c.reason
  || chr(10) || 'found: ' || c.n_occ || ' times' || CASE WHEN a.alternatives <> '' THEN chr(10) || 'instead: ' || replace(a.alternatives, ',', ' / ') ELSE '' END || chr(10) || 'in: ' || c.sentence_text
  || chr(10) || 'within: ' || c.paragraph_text || t.more) AS prompt_md5
FROM cp c LEFT JOIN alts a ON a.doc_id = c.doc_id AND a.cand_idx = c.cand_idx JOIN (
  SELECT unnest(['he', 'idiot', 'moron', 'stupid', 'trash', 'worthless', 'pathetic', 'disgusting']) AS word, 1 AS turn, '' AS more
  UNION ALL SELECT unnest(['he', 'pathetic']), 2, chr(10) || 'done: premature_finalize' || chr(10) || 'note: {U.NOTE_PREMATURE}'
  UNION ALL SELECT 'stupid', 2, chr(10) || 'done: invalid' || chr(10) || 'note: {U.NOTE_INVALID}'
  UNION ALL SELECT 'stupid', 3, chr(10) || 'done: invalid, invalid' || chr(10) || 'note: {U.NOTE_INVALID}'
  UNION ALL SELECT 'trash', 2, chr(10) || 'done: corpus_search'
  UNION ALL SELECT 'trash', 3, chr(10) || 'done: corpus_search, premature_finalize' || chr(10) || 'note: {U.NOTE_PREMATURE}') t ON t.word = lower(c.quote)""",
)
def _(spark, sf):
    asked = _turns(spark, sf, keep_prompts=True).asked.filter(~F.contains("shown", F.lit("\nsource ")))
    return asked.select("doc_id", "cand_id", "turn", F.md5(F.col("shown").cast("binary")).alias("prompt_md5"))
