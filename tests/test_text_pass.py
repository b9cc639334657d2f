"""The shared pass over the texts, and the cheaper tests inside it."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import candidates as C
from spanloom.operators import match as M
from spanloom.operators import parse as P
from spanloom.plans import catalog
from spanloom.plans.audit import text_pass
from spanloom.plans.inputs import RULES, lexicon

SF = "/root/testdata/sf0.001"
TEXTS = ["He said the idiot was there. The trash of the town.\n\nHE IS STUPID", "Approx. 5 of vol. 3. See fig. 2! Dr. No left. OK", "", "он и the"]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def test_pass_gives_what_the_operators_give(spark):
    d, lex = docs(spark), lexicon(spark)
    read = text_pass(d, lex, RULES, window_tokens=20)
    guarded = P.guard_english(P.guard_nonempty(d))
    assert rows(read.hits) == rows(M.lexicon_hits(guarded, lex)) != []
    offsets = P.window_offsets(guarded, 20)
    assert rows(read.windows.select(offsets.columns)) == rows(offsets)
    old = C.candidates_of(C.audit_documents(d, RULES, window_tokens=20)).drop("expanded")
    assert rows(C.candidates_of(read.audited).select(old.columns)) == rows(old) != []


@pytest.mark.parametrize("name", ["audit_stats", "audit_trace", "candidate_context", "investigation_prompt", "hint_adjudication", "audit_prompt"])
def test_texts_are_read_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [doc_id" not in plan  # the texts are behind the written rows


def test_roundtrip_reads_once(spark):
    plan = catalog.QUERIES["parse_roundtrip_check"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_english_by_runs_and_by_letters(spark):
    said = ["a" * 5 + "éééé", "aaaa" + "ééééé", "a b c é é é", "a b é é é", "éé aa", "ééé aa", "K é", "12", ""]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(T.is_english(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False, True, False, False]


def test_texts_of_a_search_are_not_dealt_out_by_request(spark):
    from spanloom.operators.retrieval import search_ladder

    corpus = spark.createDataFrame([(i, f"t{i}", "a word here", "T", "2020") for i in range(9)], "doc_id long, title string, description string, peerreviewed string, year string")
    out = search_ladder([{"request_id": 1, "phrases": ["word"], "any_of": [], "min_year": None}], corpus)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [0, 1, 2]
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "[request_id" in line]
    assert joins and all("BroadcastHashJoin" in j for j in joins)


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 63, 64, 65, 513, 4099])
def test_sums_of_groups(spark, size):
    from spanloom.functions.spans import offsets_before

    lengths = [i % 7 for i in range(size)]
    got = spark.createDataFrame([(lengths,)], "x array<int>").select(offsets_before(F.col("x"))).first()[0]
    assert got == [sum(lengths[:i]) for i in range(size)]


def test_words_are_counted_without_making_them(spark):
    said = ["", " \n ", "a", "  a b\n\nc\u3000", "\u3000x y", "é a", "a\tb\x1cc\x85d", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(T.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 1, 3, 2, 2, 4, None]
    assert "regexp_extract_all" not in spark.range(1).select(T.word_count(F.lit("a b")))._jdf.queryExecution().analyzed().toString()


def test_an_audit_of_flagged_documents_has_all_candidates(spark):
    d = docs(spark)
    whole = C.audit_documents(d, RULES, window_tokens=20)
    lean = C.audit_documents(d, RULES, window_tokens=20, context=False, flagged_only=True, tasks=3)
    few = C.candidates_of(lean)
    assert rows(few) == rows(C.candidates_of(whole).select(few.columns)) != []
    assert lean.count() < whole.count()
    assert not {"sentence_id", "sentence_text", "paragraph_text"} & set(few.columns)


def test_windows_are_counted_where_no_word_is_flagged(spark):
    texts = ["\n\n".join(["# Head", "one two three four five six seven. " * 9, "x y z"] * n) for n in (1, 3, 8)] + ["trash\n\n" + "a b c. " * 99]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counted = C.audit_documents(d, RULES, window_tokens=20).select("doc_id", "n_windows")
    assert rows(counted) == rows(P.window_table(d, 20).groupBy("doc_id").count())


def test_phrases_as_rules_skip_no_text(spark):
    rules = (C.Rule("old hand", "gendered", "expert"),)
    assert C.candidates_of(C.audit_documents(docs(spark), rules, window_tokens=20)).count() == 0
    d = spark.createDataFrame([(1, "She is an Old hand here.")], "doc_id bigint, text string")
    assert C.candidates_of(C.audit_documents(d, rules, window_tokens=20)).select("quote").first()[0] == "Old hand"
