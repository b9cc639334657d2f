"""The audit with a model function."""

import json

from test_audit import PLANTED, store

from spanloom.operators import candidates as C
from spanloom.plans.audit import ask_model, run_audit

SCHEMA = "ord int, term string, category string, alternatives array<string>, note string, condition string, source string"


def lexicon(spark):
    return spark.createDataFrame([(0, "Manpower", "exclusionary", ["workforce"], "", "", "house")], SCHEMA)


def test_replies_take_the_place_of_the_rules(spark, docs):
    def complete(prompts):
        """Quotes two words where they stand, fails on the last window, and invents a quote in the second."""
        out = []
        for p in prompts:
            if "closed" in p:
                out.append(None)
            elif "manpower" in p:
                out.append(json.dumps({"candidates": [{"quote": "manpower  was", "category": "exclusionary"}, {"quote": "manpower is", "category": "biased"}]}))
            else:
                out.append('Well: {"candidates": [{"quote": "chairman", "category": "Gendered", "reason": "title"}]} as asked')
        return out

    table = docs(PLANTED, "All is well in this text.", "   ")
    asked = ask_model(table, lexicon(spark), complete, window_tokens=20)
    assert {(r.doc_id, r.window_idx): r.parse_failed for r in asked.replies.collect()} == {(0, 0): False, (0, 1): False, (0, 2): True, (1, 0): False}
    result = run_audit(table, store(spark), window_tokens=20, parsed=asked.replies)
    stats = {r.doc_id: r for r in C.audit_stats(result.audited, result.candidates).collect()}
    assert set(stats) == {0, 1}
    assert (stats[0].windows, stats[0].raw_candidates, stats[0].dropped_unverified, stats[0].candidates, stats[0].windows_parse_failed) == (3, 3, 1, 2, 1)
    # the second document has no such word, so its quote is dropped
    assert (stats[1].raw_candidates, stats[1].dropped_unverified, stats[1].candidates, stats[1].windows_parse_failed) == (1, 1, 0, 0)
    found = {r.quote_key: r for r in result.candidates.collect()}
    assert set(found) == {"chairman", "manpower was"} and found["chairman"].reason == "title"
    # a quote is found whatever its white space, and reads as the text has it
    assert found["manpower was"].quote == "manpower was"
    assert result.findings.count() >= 1


def test_documents_without_replies_have_no_candidates(spark, docs):
    none = spark.createDataFrame([], "doc_id long, window_idx int, raw string")
    rows = C.audit_replies(docs(PLANTED), C.parse_responses(none), window_tokens=20).collect()
    assert [(r.n_windows, r.n_raw, r.n_failed) for r in rows] == [(3, 0, 0)]


def test_reply_to_an_unknown_window_is_dropped(spark, docs):
    raw = json.dumps({"candidates": [{"quote": "chairman", "category": "gendered"}]})
    replies = spark.createDataFrame([(0, 99, raw), (7, 0, raw)], "doc_id long, window_idx int, raw string")
    rows = C.audit_replies(docs(PLANTED), C.parse_responses(replies), window_tokens=20).collect()
    assert [(r.doc_id, r.n_raw, r.n_dropped) for r in rows] == [(0, 1, 1)]
