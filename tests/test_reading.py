"""The pass over texts in Python gives what the column expressions give."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import candidates as C
from spanloom.operators import match as M
from spanloom.operators import parse as P
from spanloom.operators import reading as R
from spanloom.plans.inputs import LEXICON, RULES, lexicon

TERMS = [e[0] for e in LEXICON]
PARTS = (
    "He the THE idiot Idiots trash license words pathetic; Dr. No. fig e.g. et_al. vs.. I. 1. 2.3 A) * - (Why) \"So é K he's he_ _he STUPID . ! ? … . 　 ￿ ſtupid a.b"
).split(" ")
GAPS = (" ", " ", " ", "", "\n", "\n\n", "\n \t\n", " . ", "  ", "." * 18, " " * 18)


def odd_texts(n=150):
    rnd = random.Random(7)
    made = ["".join(rnd.choice(PARTS).replace("_al", " al") + rnd.choice(GAPS) for _ in range(rnd.choice((3, 30, 200)))) for _ in range(n)]
    return [*made, None, "", " \n　", "of the. The of. The"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(odd_texts())), "doc_id bigint, text string").cache()


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_in_documents_makes_no_chunk_rows(spark, odd):
    lex = lexicon(spark)
    got, want = M.document_lookup(odd, lex), M.lexicon_lookup(P.chunk_table(odd), lex)
    assert rows(got) == rows(want.select(got.columns)) != []
    assert "MapInArrow" in plan(got) and "Generate" not in plan(got)


def test_terms_that_could_reach_over_a_chunk(spark, docs, lexicon):
    lex = lexicon(("end. the", "biased", (), "", ""), (" so", "biased", (), "", ""), ("été", "biased", (), "", ""))
    d = docs("The end. The end. the end. So so it was. Été.", "end. the")
    got = M.document_lookup(d, lex)
    assert rows(got) == rows(M.lexicon_lookup(P.chunk_table(d), lex).select(got.columns)) != []
    plain = lex.filter("term <> 'été'")
    got = M.document_lookup(d, plain)
    assert "MapInArrow" in plan(got)
    assert rows(got) == rows(M.lexicon_lookup(P.chunk_table(d), plain).select(got.columns)) != []


@pytest.mark.parametrize("tokens", [20, 200])
def test_windows_hits_and_hints(spark, odd, tokens):
    g, lex = P.guard_english(P.guard_nonempty(odd)).select("doc_id", "text"), lexicon(spark)
    got = R.read_texts(g, window_tokens=tokens, windows=True, window_texts=True, terms=TERMS, entries=M.hint_entries(lex)).cache()
    windows = got.select("doc_id", F.inline("windows"))
    want = P.window_table(g, tokens).drop("block_idxs")
    assert rows(windows.select(want.columns)) == rows(want) != []
    hits = M.lexicon_hits(g, lex)
    assert rows(M.hits_of_column(got, lex)) == rows(hits) != []
    hints = M.window_hints(hits, want)
    assert rows(windows.select("doc_id", "window_idx", F.inline("hints")).select(hints.columns)) == rows(hints) != []
    assert rows(M.hinted_prompts(windows)) == rows(M.audit_prompts(want, hints))


@pytest.mark.parametrize("tokens", [20, 200])
def test_candidates_of_rules(spark, odd, tokens, monkeypatch):
    got = C.audit_documents(odd, RULES, window_tokens=tokens).cache()
    assert "MapInArrow" in plan(C.audit_documents(odd, RULES, window_tokens=tokens))
    monkeypatch.setattr(C, "read_in_python", lambda rules: False)
    want = C.audit_documents(odd, RULES, window_tokens=tokens).cache()
    assert rows(got.drop("candidates")) == rows(want.drop("candidates"))
    assert rows(C.candidates_of(got)) == rows(C.candidates_of(want).select(C.candidates_of(got).columns)) != []


def test_large_vocabularies_use_an_automaton():
    terms = [e for e in TERMS] + [f"zz{i}" for i in range(R.FEW_TERMS)] + ["the the", "e.g", "g."]
    few, many = R.Vocabulary(TERMS + ["the the", "e.g", "g."], 500), R.Vocabulary(terms, 500)
    assert few.automaton is None and many.automaton is not None
    for text in odd_texts():
        if text:
            low = R.lower_ascii(text)
            assert few.spans(text, low) == many.spans(text, low)


def test_a_models_prompts_meet_no_other_table(spark):
    from spanloom.plans.audit import text_pass

    read = text_pass(spark.createDataFrame([(1, "He said the trash of the town.")], "doc_id bigint, text string"), lexicon(spark), None, window_tokens=20, window_texts=True, hints=True)
    assert read.hinted and "Join" not in plan(M.hinted_prompts(read.windows))


def test_replies_are_parsed_once(spark):
    from spanloom.operators.turns import ask_twice

    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, prompt string")
    said = C.parse_responses(ask_twice(prompts, lambda ps: ['{"x": 1}' if p == "a" else "no" for p in ps], ["doc_id"]))
    assert "response" not in plan(said) and "EvalPython" not in plan(said)
    assert rows(said.select("doc_id", "reply", "repaired", "parse_failed")) == [("1", '{"x": 1}', "False", "False"), ("2", "None", "True", "True")]


def test_candidates_are_dealt_out_once(spark, odd):
    found = C.candidates_of(C.audit_documents(odd, RULES, window_tokens=20).localCheckpoint())
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1


def test_texts_of_a_search_are_not_dealt_out(spark):
    from spanloom.operators.retrieval import search_ladder

    made = [(i, f"t{i}", "a word here" + " and there" * 50, "T", "2020") for i in range(40)]
    corpus = spark.createDataFrame(made, "doc_id long, title string, description string, peerreviewed string, year string")
    out = search_ladder([{"request_id": 1, "phrases": ["word"], "any_of": [], "min_year": None}], corpus)
    assert [(r["rank"], len(r.description_text)) for r in out.orderBy("rank").collect()] == [(1, 511), (2, 511), (3, 511)]
    held = plan(out)
    assert held.count("LeftSemi") == 1  # the corpus is cut down to the best before its texts meet anything


def test_replies_are_audited_without_context(spark):
    d = spark.createDataFrame([(1, "He said the trash of the town."), (2, "Nothing here.")], "doc_id bigint, text string")
    replies = spark.createDataFrame([(1, 0, '{"candidates": [{"quote": "the  trash", "category": "biased"}, {"quote": "not there"}]}')], "doc_id bigint, window_idx int, raw string")
    parsed = C.parse_responses(replies)
    whole, lean = C.audit_replies(d, parsed, window_tokens=20), C.audit_replies(d, parsed, window_tokens=20, expand=False, context=False)
    assert rows(lean.drop("candidates")) == rows(whole.drop("candidates")) == [("1", "1", "2", "1", "0"), ("2", "1", "0", "0", "0")]
    few = C.candidates_of(lean)
    assert rows(few) == rows(C.candidates_of(whole).select(few.columns)) != []
    assert not {"sentence_text", "expanded"} & set(few.columns)


def test_hints_of_a_model_are_not_joined_by_offset(spark):
    from spanloom.plans.audit import ask_model

    d = spark.createDataFrame([(1, "He said the trash of the town."), (2, "An idiot.")], "doc_id bigint, text string")
    asked = ask_model(d, lexicon(spark), lambda prompts: ["{}"] * len(prompts), window_tokens=20)
    assert "Join" not in plan(asked.hints)
    assert rows(asked.hints.select("doc_id", "term", "rank"))[0] == ("1", "he", "1")


def test_candidates_get_their_evidence_where_they_are(spark):
    from spanloom.operators.investigate import with_evidence

    vectors = spark.createDataFrame(
        [(1, 1, [1.0] * 64, "a", "t", ("s", "a", "t", "2020", "u"))],
        "id long, ord long, embedding array<double>, doc_key string, text string, metadata struct<source:string,doc_id:string,title:string,year:string,url:string>",
    )
    cands = spark.createDataFrame([(1, "cand0000", "He", "gendered"), (2, "cand0000", "", "")], "doc_id bigint, cand_id string, quote string, category string")
    got = with_evidence(cands, vectors)
    assert sorted((r.doc_id, len(r.evidence)) for r in got.collect()) == [(1, 1), (2, 1)]
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_other_places_of_a_phrase_are_kept_once(spark):
    d = spark.createDataFrame([(1, "\n\n".join(["He saw the trash. " * 5] * 9))], "doc_id bigint, text string")
    audited = C.audit_documents(d, RULES, window_tokens=20)
    kept = [c for c in audited.first().candidates if c.expanded is not None]
    assert len(audited.first().candidates) > 2 and sorted(c.quote for c in kept) == ["He", "trash"]
    assert [(r.quote, len(r.expanded)) for r in C.candidates_of(audited).orderBy("quote").collect()] == [("He", 90), ("trash", 45)]


@pytest.mark.parametrize("name", ["report_summary", "verdict_policy"])
def test_a_report_deals_out_no_texts(spark, monkeypatch, name):
    from spanloom.plans import audit, catalog
    from spanloom.sources import corpus

    seen = []
    monkeypatch.setattr(corpus, "SMALL_INPUT", 0)
    monkeypatch.setattr(audit, "cut_lineage", lambda df: seen.append(plan(df)) or df.localCheckpoint())
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in seen[0] and "Repartition" not in seen[0]
