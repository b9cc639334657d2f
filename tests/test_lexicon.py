from pyspark.sql import functions as F

from spanloom.operators import lexicon as L
from spanloom.sources import corpus as S

TYPE = "row_ord int, term string, category string, alternatives array<string>, note string, condition string, source string"


def test_merge_precedence(spark):
    a = spark.createDataFrame([(0, "Chairman", "gendered", ["chair"], "", "", "A"), (1, "master", "exclusionary", [], "a-note", "", "A")], TYPE)
    b = spark.createDataFrame(
        [(0, "MASTER ", "ableist", ["primary"], "b-note", "cond", "B"), (1, "freshmen", "gendered", ["new"], "", "", "B"), (2, "master", "x", ["y"], "note", "", "B")],
        TYPE,
    )
    rows = L.lexicon_merge(L.union_sources(a, b)).orderBy("ord").collect()
    assert [r.term for r in rows] == ["chairman", "master", "freshmen"]
    m = rows[1]
    assert (m.category, m.alternatives, m.note, m.condition, m.source) == ("exclusionary", ["primary"], "a-note; b-note", "cond", "A")


def test_validation_and_survival(spark):
    lex = spark.createDataFrame([("x", "nope", ["a"], "", ""), ("y", "biased", [], "", ""), ("z", "biased", [], "n", "")],
                                "term string, category string, alternatives array<string>, note string, condition string")
    assert {(r.term, r.rule) for r in L.lexicon_violations(lex).collect()} == {("x", "category"), ("y", "empty_entry")}
    required = spark.createDataFrame([("X",), ("w",)], "term string")
    assert [r.term for r in L.lost_terms(required, lex).collect()] == ["w"]


def test_rules_of_every_shape(spark):
    lines = [
        '{"inconsiderate": {"He": "m", "she": "f"}, "considerate": ["they"], "note": "n", "source": "u"}',
        '{"inconsiderate": "make * great", "considerate": "x"}',
        '{"inconsiderate": ["one", " Two "], "considerate": "single", "condition": "c"}',
    ]
    rules = S.rule_scan(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("category", F.lit("gendered")).withColumn("source_tag", F.lit("t"))
    rows = {r.term: r for r in L.rule_entries(rules).collect()}
    assert set(rows) == {"he", "she", "one", "two"}
    assert rows["he"].note == "n (see also: u)" and rows["two"].alternatives == ["single"] and rows["one"].condition == "c"


def test_condition_round_trip(spark):
    df = spark.createDataFrame([("n; more", "c"), ("", "c"), ("n", ""), ("", "")], "note string, condition string")
    folded = df.select("condition", L.note_with_condition(F.col("note"), F.col("condition")).alias("f"))
    got = folded.select("condition", "f", L.condition_of(F.col("f")).alias("back")).collect()
    assert [g.f for g in got] == ["condition: c; n; more", "condition: c", "n", ""]
    assert all(g.back == g.condition for g in got)
