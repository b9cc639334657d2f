from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions import text as T
from spanloom.operators import parse as P

PAPER = (
    "1. Introduction\n\nThis opens the paper.\nIt goes on here.\n\nGRADING POLICY\n\n- one item here\n- two items here\n- three items\n\n"
    "2.1 Late Submissions\n\nLate work is late. No excuses are taken,\nas a rule."
)


def test_block_kinds_and_offsets(docs):
    rows = P.block_table(docs(PAPER)).orderBy("block_idx").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "heading", "list", "heading", "paragraph"]
    assert all(PAPER[r.char_start : r.char_end] == r.text for r in rows)
    assert "\n" in rows[1].text


def test_one_line_bullet_without_stop_is_a_heading(docs):
    assert P.block_table(docs("- short bullet")).first().kind == "heading"


def test_headings_have_no_sentences(docs):
    rows = P.sentence_table(docs(PAPER)).orderBy("sentence_idx").collect()
    assert {r.block_idx for r in rows} == {1, 3, 5}
    assert [r.sentence_id for r in rows] == [f"s{i:04d}" for i in range(len(rows))]
    assert all(PAPER[r.char_start : r.char_end] == r.text for r in rows)


def sentences(docs, text):
    pad = " This closing part makes the block longer than any heading may ever be."
    return [r.text for r in P.sentence_table(docs(text + pad)).orderBy("sentence_idx").collect()][:-1]


def test_abbreviations_do_not_end_sentences(docs):
    assert sentences(docs, "The committee, et al. Smith found the results compelling.") == [
        "The committee, et al. Smith found the results compelling."
    ]
    assert sentences(docs, "Consider e.g. The results shown below.") == ["Consider e.g. The results shown below."]
    assert sentences(docs, "See Dr... Who said so.") == ["See Dr... Who said so."]
    assert sentences(docs, "The meeting reached its end. The next item was budget.") == [
        "The meeting reached its end.", "The next item was budget."
    ]
    assert sentences(docs, "It was lower case. then went on! \"Quoted\" start? (Yes) it was… 4 more.") == [
        "It was lower case. then went on!", "\"Quoted\" start?", "(Yes) it was…", "4 more."
    ]


def test_windows_overlap_and_headings(docs):
    text = "\n\n".join(" ".join([w] * 100) + "." for w in ("alpha", "beta", "gamma"))
    w = P.window_table(docs(text), 300).orderBy("window_idx").collect()
    assert len(w) == 2
    assert w[0].block_idxs == [0, 1] and w[1].block_idxs == [1, 2]
    assert w[1].overlap_char_end == w[0].char_end and w[0].overlap_char_end == w[0].char_start
    assert w[1].text.startswith("beta")


def test_oversize_block_is_cut_at_sentences(docs):
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    w = P.window_table(docs(text), 50).collect()
    ends = {r.char_end for r in P.sentence_table(docs(text)).collect()}
    assert len(w) > 1 and all(r.char_end in ends for r in w)
    assert P.block_table(docs(text)).count() == 1


def test_window_cap(docs):
    d = docs("One two three. " * 5, " ".join(f"Sentence number {i} is here." for i in range(60)))
    parsed = P.parse_documents(d, 20, sentences=False)
    assert [r.doc_id for r in P.guard_window_cap(parsed, 1).select("doc_id").collect()] == [0]
    assert P.guard_window_cap(parsed, 100).select("doc_id").count() == 2


def test_guards(docs):
    d = docs("Plain English.", "שלום עולם", "  \n", "1234 !!! ...", "abא", "אבa")
    got = {r.doc_id: r.reason for r in P.guard_verdicts(d).collect()}
    assert got == {0: None, 1: "not_english", 2: "empty", 3: "not_english", 4: None, 5: "not_english"}


def test_roundtrip_has_no_violations(docs):
    odd = "Astral \U0001f600 text. Next one here.\x1c\n \x0b\nMark ￿ inside. And more words to be a paragraph of length, yes it is so."
    assert P.roundtrip_violations(docs(PAPER, odd)).count() == 0


def test_prefix_sums_beyond_one_chunk(spark):
    n = S.SCAN_CHUNK * 2 + 7
    row = spark.range(1).select(S.offsets_before(F.sequence(F.lit(1), F.lit(n))).alias("o")).first()
    assert row.o == [i * (i + 1) // 2 for i in range(n)]


def test_marker_characters_in_the_text_keep_offsets(docs):
    text = "x￿ idiot ￿￿ idiot"
    spans = docs(text).select(F.inline(S.match_spans(F.col("text"), T.word_regex("idiot")))).collect()
    assert [(s.char_start, s.char_end) for s in spans] == [(3, 8), (12, 17)]


def test_chunks_carry_context(docs):
    rows = P.chunk_table(docs("  First one. Second two! third three? Fourth"), 5).orderBy("chunk_idx").collect()
    assert [r.text for r in rows] == ["First one.", "Second two! third three?", "Fourth"]
    assert rows[1].context_before == "one. " and rows[1].context_after == " Four"


def test_points_and_overlaps_across_buckets(spark):
    points = spark.createDataFrame([(1, i * 37) for i in range(200)], "doc_id int, p int")
    intervals = spark.createDataFrame([(1, i * 90, i * 90 + 150 + i) for i in range(60)], "doc_id int, s int, e int")
    got = {(r.p, r.s) for r in S.points_in_intervals(points, intervals, point="p", start="s", end="e", bucket=64).collect()}
    want = {(i * 37, j * 90) for i in range(200) for j in range(60) if j * 90 <= i * 37 < j * 90 + 150 + j}
    assert got == want
    left = spark.createDataFrame([(1, i * 41, i * 41 + 100) for i in range(80)], "doc_id int, a int, b int")
    rows = S.overlapping_spans(left, intervals, left_span=("a", "b"), right_span=("s", "e"), bucket=64).collect()
    pairs = [(r.a, r.s) for r in rows]
    brute = {(i * 41, j * 90) for i in range(80) for j in range(60) if i * 41 < j * 90 + 150 + j and j * 90 < i * 41 + 100}
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute


def test_runs_of_dots_and_spaces_of_any_length_belong_to_an_abbreviation(docs):
    for run in ("." * 30, " " * 40 + ".", "." * 5000, "." * 20 + " " * 20 + "."):
        assert sentences(docs, f"See vol{run} One of them.") == [f"See vol{run} One of them."]
    text = "See fig. 3 here. It ends" + "." * 30 + " New one. He met Smith et" + " " * 30 + "al. In May, cf. No more!"
    assert sentences(docs, text) == ["See fig. 3 here.", "It ends" + "." * 30, "New one.", "He met Smith et" + " " * 30 + "al. In May, cf. No more!"]


def test_both_ways_of_cutting_sentences_agree(spark, monkeypatch):
    import random

    rng = random.Random(4)
    parts = ["See", "vol", "No", "et", "al", "e.g", "Fig.", "end.", "stop!", "(A)", "9", "…", ".", "..", "word", "i.e."]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\n", "."]) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    usual = [r.s for r in df.select(P.sentence_spans(F.col("text")).alias("s")).collect()]
    monkeypatch.setattr(P, "_LONG_RUN", "(?s).*")
    assert [r.s for r in df.select(P.sentence_spans(F.col("text")).alias("s")).collect()] == usual
