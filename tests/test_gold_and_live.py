import json

from pyspark.sql import functions as F

from spanloom.operators import investigate as I
from spanloom.operators import report as R
from spanloom.operators.candidates import Rule
from spanloom.sources import corpus as S
from spanloom.sources import sinks
from spanloom.streaming import jobs


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text("".join(json.dumps({"lang": "EN" if i % 2 else "HE", "label": "x", "sentence": f"s{i}"}) + "\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = S.numbered_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 1
        assert {r.row_idx: json.loads(r.line)["sentence"] for r in lines.collect()} == {i: f"s{i}" for i in range(500)}
        kept = {r.row_idx: r.sentence for r in S.read_gold_jsonl(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kept == {i: f"s{i}" for i in range(500) if i % 2 and i not in S.EXEMPLAR_ROWS}


def test_gold_sentences_of_missing_file_and_of_any_column_order(spark, tmp_path):
    assert S.read_gold_sentences(spark, str(tmp_path / "none.csv")).count() == 0
    path = tmp_path / "g.csv"
    path.write_text('expected_label_raw,id,sentence\nBiased,1,"a, ""b""\nc"\nOther,2,d\nCorrect,3,e\n')
    rows = {r.text: (r.expected_flag, r.expected_category, r.language) for r in S.read_gold_sentences(spark, str(path)).collect()}
    assert rows == {'a, "b"\nc': (True, "biased", "EN"), "e": (False, None, "EN")}


def test_corpus_keeps_white_space_and_quotes(spark, tmp_path):
    text = '  he said "x",\n\\ and  '
    df = spark.createDataFrame([tuple("1" if c != "chunk_text" else text for c in S.CORPUS_COLUMNS)], list(S.CORPUS_COLUMNS))
    sinks.write_corpus(df, str(tmp_path / "c"))
    sinks.write_corpus(df, str(tmp_path / "c"))
    assert [r.chunk_text for r in S.read_corpus(spark, str(tmp_path / "c")).collect()] == [text, text]


def test_gold_documents_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("a", "some text"), ("b", "none")], "doc_id string, text string")
    spans = spark.createDataFrame(
        [("a", 1, 5, 9, ["x", "y"], 1, "text"), ("a", 0, 0, 4, ["x"], 1, "some")],
        "doc_id string, gold_idx int, char_start bigint, char_end bigint, labels array<string>, page bigint, text string",
    )
    sinks.write_gold_documents(texts, spans, str(tmp_path / "g"))
    back = {r.doc_id: (r.fulltext, [(s.char_start, s.labels) for s in r.spans]) for r in S.read_gold_documents(spark, str(tmp_path / "g")).collect()}
    assert back == {"a": ("some text", [(0, ["x"]), (5, ["x", "y"])]), "b": ("none", [])}


def test_weak_candidate_is_searched_and_judged_again(spark):
    found = spark.createDataFrame([("d", "c1", "moron", "biased"), ("e", "c1", "Moron", "biased"), ("d", "c2", "zzz", "biased")], "doc_id string, cand_id string, quote string, category string")
    corpus = spark.createDataFrame(
        [(f"p{i}", "t", "moron", "T", "2020") for i in range(3)], "doc_id string, title string, description string, peerreviewed string, year string"
    )
    live = I.live_search(found, corpus)
    assert sorted((r.doc_id, r.cand_id, len(r.evidence)) for r in live.collect()) == [("d", "c1", 3), ("e", "c1", 3)]
    judged = I.verdict_policy(found.withColumn("evidence", F.array().cast(I.EVIDENCE)), [Rule("moron", "biased", "person")], live_available=True)
    out = {(r.doc_id, r.cand_id): (r.confidence, len(r.evidence)) for r in I.escalate(judged, live, [Rule("moron", "biased", "person")]).collect()}
    assert out == {("d", "c1"): ("high", 3), ("e", "c1"): ("high", 3), ("d", "c2"): ("low", 0)}


def test_report_document_rules(spark):
    good = {"version": R.VERSION, "language": "en", "summary": dict.fromkeys([*R.COUNTS, "patterns"], 0), "patterns": [], "findings": []}
    bad = {"version": "1", "summary": {}, "patterns": [{"framing": "f"}]}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, None)], "doc_id int, report string")
    found = {(r.doc_id, r.rule) for r in R.document_violations(rows).collect()}
    assert {d for d, _ in found} == {2, 3}
    assert {r for d, r in found if d == 2} == {"version", "language", "pattern", "findings", *[f"summary:{c}" for c in (*R.COUNTS, "patterns")]}


def test_store_has_last_write_per_id(spark, tmp_path):
    rows = lambda t: spark.createDataFrame([("x", t)], "id string, text string")
    rows("z old").write.parquet(str(tmp_path / "s/batch=9"))
    rows("new").write.parquet(str(tmp_path / "s/batch=10"))
    assert [tuple(r) for r in jobs.read_store(spark, str(tmp_path / "s")).collect()] == [("x", "new")]
