import pytest
from pyspark.sql import functions as F

from spanloom.functions import ordered as O
from spanloom.operators import align as A
from spanloom.operators import evaluate as E
from spanloom.operators import telemetry as M
from spanloom.plans import catalog, catalog_report, inputs
from spanloom.sources import corpus as S
from spanloom.sources import sinks
from spanloom.streaming import jobs

GOLD = "doc_id int, gold_idx int, char_start int, char_end int, labels array<string>"
PRED = "doc_id int, pred_idx int, char_start int, char_end int, category string"


def outcome(spark, gold, pred):
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)
    return E.match_outcome(E.best_gold_match(p, g)), g


def test_overlap_threshold_and_zero_length_gold(spark):
    o, g = outcome(spark, [(1, 0, 0, 10, ["outdated"]), (1, 1, 3, 3, ["biased"])], [(1, 0, 0, 6, "outdated")])
    assert o.first().outcome == "tp" and E.fp_on_correct_rate(o).first().rate == 0.0
    o, g = outcome(spark, [(1, 0, 0, 10, ["outdated"])], [(1, 0, 0, 4, "outdated")])
    assert o.first().outcome == "unmatched_fp"
    assert [(r.label, r.tp, r.fp, r.fn) for r in E.per_label_prf(o, g).collect()] == [("outdated", 0, 1, 1)]


def test_correct_span_and_label_miss(spark):
    o, g = outcome(spark, [(1, 0, 0, 20, ["Correct"])], [(1, 0, 0, 20, "biased")])
    assert E.fp_on_correct_rate(o).first().rate == 1.0 and E.span_detection(o, g).first().fn == 0
    o, g = outcome(spark, [(1, 0, 0, 20, ["Biased"])], [(1, 0, 0, 20, "outdated")])
    assert o.first().outcome == "label_miss" and E.span_detection(o, g).first().tp == 1
    assert E.gold_label_recall(o, g).first().recall == 1.0 and E.micro_prf(E.per_label_prf(o, g)).first().f1 == 0.0


def test_ties_go_to_the_lowest_gold_index(spark):
    o, _ = outcome(spark, [(1, 5, 0, 10, ["a"]), (1, 2, 10, 20, ["b"])], [(1, 0, 0, 20, "a")])
    assert o.first().gold_idx == 2


def test_binary_scores(spark):
    df = spark.createDataFrame([(True, True)] * 4 + [(False, False)] * 4, "predicted boolean, expected boolean")
    assert E.binary_prf(df).first().f1 == 1.0
    none = df.withColumn("predicted", F.lit(False))
    r = E.binary_prf(none).first()
    assert (r.tp, r.fp, r.precision, r.f1) == (0, 0, 0.0, 0.0)
    with pytest.raises(Exception, match="differ in length"):
        E.binary_prf(df.withColumn("predicted", F.lit(None).cast("boolean"))).collect()


def test_running_sums_and_lags_of_a_hot_key(spark):
    rows = [(1, i * 3, i % 5) for i in range(400)] + [(2, i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, o long, v int")
    got = {(r.k, r.o): r.s for r in O.running_sums(df, ["k"], "o", {"s": F.col("v").cast("long")}, width=50).collect()}
    total = 0
    for k, o, v in rows[:400]:
        total += v
        assert got[(k, o)] == total
    lag = {(r.k, r.o): r.p for r in O.previous_values(df, ["k"], "o", {"p": "v"}, width=50).collect()}
    assert lag[(1, 0)] is None and all(lag[(1, i * 3)] == (i - 1) % 5 for i in range(1, 400))


def test_usage(spark):
    ledger = spark.createDataFrame([(1, 0, 10, 4), (1, 1, 17, 7)], "run_id int, step_idx int, cum_in long, cum_out long")
    rows = M.usage_delta(ledger).orderBy("step_idx").collect()
    assert [(r.delta_in, r.delta_out) for r in rows] == [(10, 4), (7, 3)]
    steps = spark.createDataFrame([(1, None, None), (2, 0, 0), (3, 5, None)], "run_id int, tokens_in int, tokens_out int")
    got = {r.run_id: (r.tokens_in, r.tokens_out) for r in M.run_log_rows(steps).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (5, 0)}


def test_highlights_merge_on_the_first_y_and_align(spark):
    rows = [(1, 1, 10.0, 0, "same-gender orientation", "a"), (1, 1, 14.0, 1, "same-gender orientation", "b"), (1, 1, 18.0, 2, "same-gender orientation", "c"), (1, 1, 40.0, 3, "some words x", "a"), (1, 1, 60.0, 4, "absent", "a")]
    groups = A.highlight_merge(spark.createDataFrame(rows, "doc_id int, page int, y double, pos int, text string, label string"))
    g = groups.orderBy("group_idx").collect()
    assert [r.labels for r in g] == [["a", "b"], ["c"], ["a"], ["a"]]
    pages = spark.createDataFrame([(1, 0, "Front page"), (1, 1, "Of same-\ngender orientation, and same-gender orientation. some\n words follow")], "doc_id int, page int, text string")
    full = "Front page\n\nOf same-\ngender orientation, and same-gender orientation. some\n words follow"
    out = A.highlight_align(groups, pages, A.page_offsets(pages, width=1)).orderBy("group_idx").collect()
    assert [full[r.char_start : r.char_end] for r in out[:3]] == ["same-\ngender orientation", "same-gender orientation", "some\n words"]
    assert out[3].char_start is None
    report = A.match_report(groups.sparkSession.createDataFrame(out)).first()
    assert (report.matched, report.total, report.passes) == (4, 5, False)


def test_highlights_of_pages_without_text_or_page_have_no_place(spark):
    rows = [(1, 1, 0, "two words", ["a"], 1), (1, 2, 0, "gone", ["a"], 1), (1, 3, 0, "gone", ["b"], 2), (1, 1, 1, "x - y", ["b"], 1)]
    groups = spark.createDataFrame(rows, "doc_id int, page int, group_idx int, text string, labels array<string>, n_rows long")
    pages = spark.createDataFrame([(1, 1, " \n two \t words- \n x -  y"), (1, 2, None)], "doc_id int, page int, text string")
    offsets = spark.createDataFrame([(1, 1, 100), (1, 2, 200)], "doc_id int, page int, page_start long")
    out = {(r.page, r.group_idx): (r.char_start, r.char_end, r.labels) for r in A.highlight_align(groups, pages, offsets).collect()}
    assert out == {(1, 0): (103, 114, ["a"]), (2, 0): (None, None, ["a"]), (3, 0): (None, None, ["b"]), (1, 1): (118, 124, ["b"])}


def test_baseline_audit_cuts_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "A moron here. An oxymoron there. He left the Idiot alone."), (2, None)], "doc_id long, text string")
    out = E.baseline_audit(docs, inputs.lexicon(spark), inputs.RULES)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.chunk_idx, r.category, r.reason) for r in out.collect()) == [(0, "exclusionary", "contains: moron"), (2, "gendered", "contains: he")]


def test_gold_spans_are_placed_once_per_metric(spark, monkeypatch):
    gold = spark.createDataFrame([(1, 0, 0, 10, ["biased"]), (1, 1, 50, 60, ["outdated"])], "doc_id long, gold_idx int, char_start int, char_end int, labels array<string>")
    found = spark.createDataFrame([(1, 0, 0, 8, "biased")], "doc_id long, pred_idx int, char_start int, char_end int, category string")
    calls = []
    monkeypatch.setattr(catalog_report, "gold", lambda *_: calls.append(1) or gold)
    monkeypatch.setattr(catalog_report, "predictions", lambda *_: found)
    rows = catalog.QUERIES["gold_label_recall"](spark, "").collect()
    assert len(calls) == 1 and sorted((r.label, r.detected, r.total) for r in rows) == [("biased", 1, 1), ("outdated", 0, 1)]


def test_corpus_csv_round_trip_and_ingest(spark, tmp_path):
    rows = [(str(i), "eric", f"D{i}", 'A "title", ok', "abstract", text, "s", "2020", "T", "u", "l") for i, text in enumerate(["one\ntwo", "  ", "three", "four"])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in S.CORPUS_COLUMNS))
    sinks.write_corpus(df, str(tmp_path / "c"), append=False)
    back = S.corpus_scan(S.read_corpus(spark, str(tmp_path / "c")))
    assert sorted(r.chunk_text for r in back.collect()) == ["four", "one\ntwo", "three"]
    assert jobs.ingest_batch(df, 0, str(tmp_path / "store"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3

    def broken(_):
        return F.assert_true(F.lit(False)).cast("string")

    assert not jobs.ingest_batch(df, 1, str(tmp_path / "store"), str(tmp_path / "dead"), embedder=broken, attempts=2)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 4


def test_append_continues_ids_and_keeps_the_first_fetch(spark):
    cols = "chunk_id string, doc_id string"
    existing = spark.createDataFrame([("7", "A"), ("x", "B")], cols)
    docs = spark.createDataFrame([(0, 0, "A", "t"), (0, 1, "C", "t0"), (1, 0, "C", "t1"), (1, 1, "E", " "), (1, 2, "F", "t")], "query_idx int, pos int, id string, description string")
    out = S.corpus_append_dedup(existing, S.api_doc_normalize(docs), width=1).orderBy(F.col("chunk_id").cast("int")).collect()
    assert [(r.chunk_id, r.doc_id, r.chunk_text) for r in out] == [("8", "C", "t0"), ("9", "F", "t")]


def test_upsert_last_write_first_place(spark):
    t = "id string, embedding array<float>, text string, ord long"
    store = spark.createDataFrame([("a", [1.0, 0.0], "old", 0), ("b", [0.0, 1.0], "b", 1)], t)
    batches = spark.createDataFrame([("a", [0.5, 0.5], "new", 2, 0), ("c", [1.0, 1.0], "c", 3, 0)], t + ", batch long")
    rows = S.vector_upsert(store, batches, 2).orderBy("ord").collect()
    assert [(r.id, r.text) for r in rows] == [("a", "new"), ("b", "b"), ("c", "c")]


def test_every_sql_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 130
