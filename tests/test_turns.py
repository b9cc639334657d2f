"""Investigation by a model, turn by turn."""

import json

from test_audit import PLANTED, store

from spanloom.operators import match as M
from spanloom.operators import turns as U
from spanloom.plans.audit import run_audit

CONTEXT = "doc_id long, cand_id string, quote string, category string, reason string, sentence_text string, paragraph_text string, alternatives array<string>, occurrences_count int"
LEXICON = "ord int, term string, category string, alternatives array<string>, note string, condition string, source string"
SEARCH = json.dumps({"action": "corpus_search", "query": "title"})
CONFIRM = json.dumps({"action": "finalize", "verdict": "confirmed", "category": "gendered", "confidence": "high", "rewrite": "chair"})


def context(spark, *quotes):
    rows = [(1, f"cand{i:04}", q, "gendered", "r", f"The {q} sits.", "All of it.", ["x", "y"] if i else [], 2) for i, q in enumerate(quotes)]
    return spark.createDataFrame(rows, CONTEXT)


def run(spark, complete, *quotes, **options):
    turns = U.investigate_turns(context(spark, *quotes), store(spark), complete, **options)
    return {r.quote: r for r in turns.results.collect()}, turns.asked.collect()


def test_live_search_is_refused_without_a_corpus_and_open_candidates_are_forced(spark):
    def complete(prompts):
        return [json.dumps({"action": "live_search", "phrases": ["x"]}) if "phrase: never" in p else CONFIRM if "source 1" in p else SEARCH for p in prompts]

    got, asked = run(spark, complete, "never", "chairman", keep_prompts=True)
    assert got["never"].actions == ["invalid"] * 4 and got["never"].forced and got["never"].verdict == "confirmed" and got["never"].confidence == "low"
    assert got["chairman"].actions == ["corpus_search", "finalize"] and not got["chairman"].forced and [e.n for e in got["chairman"].evidence] == list(range(1, len(got["chairman"].evidence) + 1))
    shown = {(r.cand_id, r.turn): r.shown for r in asked}
    assert len(shown) == 6  # a decided candidate is not asked again
    assert U.NOTE_NO_LIVE in shown["cand0000", 2] and "live_search" not in shown["cand0000", 1] and "instead: x / y" in shown["cand0001", 1]


def test_the_same_source_counts_once_and_last_searches_are_kept(spark):
    got, _ = run(spark, lambda prompts: [SEARCH] * len(prompts), "chairman", max_turns=3)
    ids = [e.id for e in got["chairman"].evidence]
    assert len(ids) == len(set(ids)) > 0 and got["chairman"].turns == 3 and got["chairman"].forced


def test_only_unreadable_replies_are_asked_again(spark):
    def complete(prompts):
        return [(CONFIRM.replace("confirmed", "rejected") if p.endswith(U.REPAIR) else None) if "phrase: shy" in p else "[1]" if "phrase: list" in p else json.dumps({"action": "finalize", "verdict": "?"}) for p in prompts]

    got, asked = run(spark, complete, "shy", "list", "plain")
    assert (got["shy"].verdict, got["shy"].turns) == ("rejected", 1) and (got["plain"].verdict, got["plain"].confidence) == ("rejected", "low") and got["list"].forced
    assert {(r.cand_id, r.repaired) for r in asked} == {("cand0000", True), ("cand0001", True), ("cand0002", False)}


def test_no_candidates(spark):
    turns = U.investigate_turns(context(spark, "x").limit(0), store(spark), lambda p: [SEARCH] * len(p))
    assert turns.results.count() == 0 and turns.asked.count() == 0


def test_an_audit_with_a_model_as_investigator(spark, docs):
    table = docs(PLANTED)
    lexicon = spark.createDataFrame([(0, "chairman", "gendered", ["chair"], "", "", "house")], LEXICON)
    complete = lambda prompts: [CONFIRM if "source 1" in p else SEARCH for p in prompts]
    result = run_audit(table, store(spark), window_tokens=20, investigator=lambda c: U.investigate_with_model(c, M.lexicon_hits(table, lexicon), store(spark), complete))
    found = result.investigations.collect()
    assert found and all(r.verdict == "confirmed" and r.rewrite == "chair" and r.turns == 2 for r in found)
    assert result.findings.count() == len(found) and result.summary.collect()[0]["confirmed"] == len(found)
