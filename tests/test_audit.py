import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.functions.responses import response_json, response_sequence
from spanloom.operators import candidates as C
from spanloom.operators import consolidate as K
from spanloom.operators import investigate as I
from spanloom.operators import parse as P
from spanloom.operators import report as R
from spanloom.operators import retrieval as G
from spanloom.plans.audit import run_audit

PLANTED = (
    "The chairman opened the long meeting and then spoke about the plans at length.\n\n"
    "The committee found that manpower was short in every one of the departments here.\n\n"
    "Later on the chairman closed the long meeting and thanked all of them very much."
)


def store(spark, n=4, dim=64):
    rows = [(f"v{i}", i, f"text {i}", f"d{i % 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, ord long, text string, doc_key string")
    meta = F.struct(F.lit("s").alias("source"), F.col("doc_key").alias("doc_id"), F.lit("T").alias("title"), F.lit("2020").alias("year"), F.lit("").alias("url"))
    return df.withColumn("embedding", V.hash_embed(F.col("text"), dim)).withColumn("metadata", meta)


def test_planted_document(docs):
    audited = C.audit_documents(docs(PLANTED, "All is well in this text."), window_tokens=20)
    rows = {r.doc_id: r for r in audited.collect()}
    assert rows[0].n_windows == 3 and rows[1].candidates is None
    cands = {r.quote_key: r for r in C.candidates_of(audited).collect()}
    assert set(cands) == {"chairman", "manpower"}
    assert len(cands["chairman"].occurrences) == 2 and len(cands["manpower"].occurrences) == 1
    assert cands["chairman"].sentence_text.startswith("The chairman opened")
    assert all(PLANTED[c.char_start : c.char_end] == c.quote for c in cands.values())


def test_find_quote_across_line_breaks(docs):
    text = "Announcement: The chairman\n will hold extra hours. repeat repeat repeat"
    d = docs(text)

    def find(quote, start=0):
        r = d.select(C.find_quote(F.col("text"), F.lit(quote), F.lit(start)).alias("f")).first().f
        return r and (r.char_start, r.char_end)

    a, b = find("The  chairman\nwill  hold")
    assert text[a:b] == "The chairman\n will hold"
    at = text.index("repeat")
    assert find("repeat", at + 1) == (at + 7, at + 13)
    assert find("(not. here)") is None and find("") == (0, 0)


def test_expansion_has_no_word_boundary(docs):
    d = docs("He said the theme. he")
    got = d.select(F.size(C.expanded_occurrences(F.col("text"), F.lit("he"))).alias("n"), F.size(C.expanded_occurrences(F.col("text"), F.lit("he"), word_boundary=True)).alias("w")).first()
    assert (got.n, got.w) == (4, 2)


def test_model_candidates_are_verified(spark, docs):
    raw = json.dumps({"candidates": [{"quote": "manpower  was", "category": "Factually_Incorrect", "lexicon_backed": False}, {"quote": "absent"}, {"category": "x"}]})
    replies = spark.createDataFrame([(0, 0, "Sure: " + raw), (0, 1, "none")], "doc_id long, window_idx int, raw string")
    parsed = C.parse_responses(replies)
    assert [r.parse_failed for r in parsed.orderBy("window_idx").collect()] == [False, True]
    cands = C.candidate_normalize(parsed)
    rows = C.verify_quotes(cands, P.window_offsets(docs(PLANTED)), docs(PLANTED)).orderBy("pos").collect()
    assert [r.accepted for r in rows] == [True, False]
    assert rows[0].quote == "manpower was" and rows[0].category == "factually-incorrect" and not rows[0].lexicon_backed


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 2}\n``` y', {"a": 2}), ('pre {bad} {"a": {"b": "}"}} post', None), ("", None), ("no { json", None), ('see {"a": 3} ok', {"a": 3})],
)
def test_first_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "raw string").select(response_json(F.col("raw"))).first()[0]
    assert (json.loads(got) if got else None) == want or (want is None and text.startswith("pre"))


def test_json_sequence(spark):
    cases = {
        '{"a": 1}\n{"b": 2}': [{"a": 1}, {"b": 2}], '{"a": "x} {y"}{"b": [1, 2]} [3]': [{"a": "x} {y"}, {"b": [1, 2]}, [3]], '1 2\n"a" "b\\" c" {"d":\n 1}': [1, 2, "a", 'b" c', {"d": 1}],
        ' {"a": [1,\n 2]} ': {"a": [1, 2]}, "[1]\n": [1], "": None, '{"a": 1} trailing': None, "text": None, '{"a": 1} {"b"': None, None: None, '{"a": 1}\n{"b": 2}\n': [{"a": 1}, {"b": 2}],
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, raw string").select("i", response_sequence(F.col("raw")).alias("got")).collect()
    for r in rows:
        assert (json.loads(r.got) if r.got else None) == list(cases.values())[r.i], list(cases)[r.i]


def test_run_audit_end_to_end(spark, docs):
    text = "The chairman told the freshmen that manpower was short this semester, as it was before and will be."
    a = run_audit(docs(text, "Nothing to see in this other text, which is fine."), store(spark), materialize=True)
    decided = a.decided.orderBy("cand_idx").collect()
    assert len(decided) == 3 and all(r.verdict == "confirmed" for r in decided)
    assert all((r.confidence == "low") == (r.top_score < 0.3) for r in decided)
    low = [r.cand_idx for r in decided if r.confidence == "low"]
    assert [r.cand_idx for r in decided if r.retracted] == low[:1]
    assert R.report_violations(a.findings).count() == 0
    summary = {r.doc_id: r for r in a.summary.collect()}
    assert summary[0].confirmed == 3 and summary[1].confirmed == 0
    md = {r.doc_id: r.markdown for r in R.report_markdown(a.summary, a.findings, a.patterns).collect()}
    assert "Nothing was confirmed." in md[1] and "## Findings" in md[0]
    report = json.loads(R.report_json(a.summary, a.findings, a.patterns).filter("doc_id = 0").first().report)
    assert len(report["findings"]) == 3 and set(report["findings"][0]) >= {"offsets", "evidence", "retraction_rationale"}


def test_technical_word_is_rejected_and_no_evidence_is_capped(spark):
    empty = store(spark).limit(0)
    spans = spark.createDataFrame([(1, "c0", "Master branch", "biased", "r"), (1, "c1", "his", "gendered", "r")], "doc_id long, cand_id string, quote string, category string, reason string")
    spans = spans.withColumn("occurrences", F.array().cast("array<struct<char_start:int,char_end:int>>"))
    rows = {r.cand_id: r for r in I.investigate(spans, empty).collect()}
    assert rows["c0"].verdict == "rejected" and rows["c0"].turns == 2
    assert rows["c1"].confidence == "low" and rows["c1"].turns == 3 and rows["c1"].confidence_capped
    assert rows["c1"].actions == ["corpus_search", "premature_finalize", "finalize"]
    assert rows["c1"].explanation.endswith("(no supporting evidence was retrieved)")


def test_consolidation_of_a_wrong_reply(spark):
    confirmed = spark.createDataFrame([(1, i, f"c{i}") for i in range(4)], "doc_id int, cand_idx int, cand_id string")
    kept = spark.createDataFrame([(1, 0, "c2"), (1, 1, "zz"), (1, 2, "c1")], "doc_id int, pos int, cand_id string")
    gone = spark.createDataFrame([(1, 0, "c1", "dup"), (1, 1, "yy", "?")], "doc_id int, pos int, cand_id string, rationale string")
    rows = K.consolidation_integrity(confirmed, kept, gone).orderBy("final_pos").collect()
    assert [(r.cand_id, r.retracted) for r in rows] == [("c2", False), ("c0", False), ("c3", False), ("c1", True)]


def brute_topk(queries, vectors, k):
    out = set()
    for q, qv in queries:
        scored = sorted(((-sum(a * b for a, b in zip(qv, v)) / (sum(a * a for a in qv) ** 0.5 * sum(b * b for b in v) ** 0.5), o) for o, v in vectors))
        out |= {(q, o, r + 1) for r, (_, o) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("limit", [100, 0])
def test_topk_is_exact_with_ties(spark, limit):
    import random

    rnd = random.Random(1)
    base = [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(30)]
    vectors = [(i, base[i % 30]) for i in range(90)]
    queries = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(7)]
    v = spark.createDataFrame([(f"v{i}", i, x) for i, x in vectors], "id string, ord long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    got = {(r.query_id, r.ord, r.rank) for r in G.vector_topk(q, v, 4, max_broadcast=limit).collect()}
    assert got == brute_topk(queries, vectors, 4)


def test_topk_by_doc_keeps_best_per_document(spark):
    v = spark.createDataFrame(
        [("c1", 0, [1.0, 0.0], "A"), ("c2", 1, [0.95, 0.1], "A"), ("c3", 2, [0.7, 0.6], "B"), ("c4", 3, [0.5, 0.8], None)],
        "id string, ord long, embedding array<double>, doc_key string",
    )
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.id for r in G.topk_by_doc(q, v, 2).orderBy("rank").collect()] == ["c1", "c3"]


def test_compile_query(spark):
    r = spark.createDataFrame([(["gendered language", "occupational titles"], ["curriculum", "syllabus"], 2015)], "phrases array<string>, any_of array<string>, min_year int")
    q = [r.select(G.compile_query(F.col("phrases"), F.col("any_of"), F.col("min_year"), i).alias("q")).first().q for i in (1, 2, 3)]
    assert q[0] == '"gendered language" AND "occupational titles" AND (curriculum OR curriculums OR syllabus) AND peerreviewed:T AND publicationdateyear:[2015 TO 2026]'
    assert q[1] == '"gendered language" AND "occupational titles" AND (curriculum OR curriculums OR syllabus)'
    assert q[2] == "gendered language occupational titles curriculum syllabus"


def test_model_hook_runs_over_prompts(spark):
    p = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "call_id int, prompt string")
    got = {r.call_id: r.raw for r in I.call_model(p, lambda prompts: [x.upper() for x in prompts]).collect()}
    assert got == {i: f"P{i}" for i in range(5)}


def test_dimension_is_checked(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    assert V.check_dim(df, "embedding", 2).count() == 1
    with pytest.raises(Exception, match="not of dimension"):
        V.check_dim(df, "embedding", 3).collect()
