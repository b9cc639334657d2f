import re

from spanloom.functions.wordtrie import vocabulary_regex
from spanloom.operators import match as M
from spanloom.operators import parse as P


def test_word_boundaries_and_longest_first(docs, lexicon):
    lex = lexicon(("he", "gendered", ["they"], "", ""), ("sanity check", "ableist", ["check"], "n", "c"), ("check", "x", [], "", ""))
    hits = M.lexicon_hits(docs("The committee approved. Run a Sanity Check; check élhe he."), lex).orderBy("char_start").collect()
    assert [(h.term, h.char_start) for h in hits] == [("sanity check", 30), ("check", 44), ("he", 55)]
    assert hits[0].note == "condition: c; n"


def test_batches_may_overlap(docs, lexicon):
    lex = lexicon(("sanity check", "a", [], "", ""), ("check", "b", [], "", ""))
    d = docs("a sanity check")
    assert M.lexicon_hits(d, lex, batch_size=1).count() == 2
    assert M.lexicon_hits(d, lex, batch_size=500).count() == 1
    assert M.sliced_lexicon_hits(d, lex, slices=2, batch_size=1).count() == 2


def test_trie_equals_flat_alternation():
    import re

    words = ["he", "hers", "her", "the", "them", "man-hours", "man"]
    pattern = vocabulary_regex(words)
    assert "(?i:" in pattern
    flat = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")\b", re.I)
    assert flat.findall("Hers them man-hours, man he") == ["Hers", "them", "man-hours", "man", "he"]


def test_lookup_searches_terms_independently(docs, lexicon):
    lex = lexicon(("sanity check", "a", [], "", ""), ("check", "b", [], "", ""))
    assert M.document_lookup(docs("A sanity check. Nothing here."), lex).count() == 2


def test_hints_rarest_first_capped_with_samples(docs, lexicon):
    terms = [f"term{i}" for i in range(25)]
    text = " ".join(" ".join([t] * (i + 1)) for i, t in enumerate(terms))
    lex = lexicon(*[(t, "gendered", ["a", "b", "c", "d"], "", "") for t in terms])
    d = docs(text)
    hits, windows = M.lexicon_hits(d, lex), P.window_offsets(d)
    hints = M.window_hints(hits, windows).orderBy("rank").collect()
    assert [h.term for h in hints] == terms[:20]
    five = next(h for h in hints if h.term == "term4")
    assert five.hit_count == 5 and len(five.sample_offsets) == 3 and five.alternatives == ["a", "b", "c"]


def test_every_hint_gets_one_verdict(spark, docs, lexicon):
    lex = lexicon(("he", "g", [], "", ""), ("his", "g", [], "", ""), ("man", "g", [], "", ""))
    d = docs("he and his man")
    hints = M.window_hints(M.lexicon_hits(d, lex), P.window_offsets(d))
    v = spark.createDataFrame(
        [(0, 0, "he", "clean", 0), (0, 0, "he", "flag", 1), (0, 0, "his", "maybe", 2), (0, 0, "zzz", "flag", 3)],
        "doc_id long, window_idx int, term string, verdict string, pos int",
    )
    got = {r.term: (r.verdict, r.filled) for r in M.hint_adjudication(hints, v).collect()}
    assert got == {"he": ("flag", False), "his": ("clean", False), "man": ("clean", True)}
    prompt = M.audit_prompts(P.window_table(d), hints).first().prompt
    assert "<passage>\nhe and his man\n</passage>" in prompt and all(f"\n{i}. " in prompt for i in (1, 2, 3))


def test_lexicon_may_be_empty_upper_case_or_repeated(spark, docs, lexicon):
    d = docs("The Chairman met a chairman")
    none = lexicon(("x", "g", [], "", "")).limit(0)
    assert M.lexicon_hits(d, none).count() == 0 and M.document_lookup(d, none).count() == 0
    twice = lexicon(("Chairman", "first", [], "", ""), ("chairman", "second", [], "", ""), (" ", "blank", [], "", ""))
    assert [(r.term, r.category) for r in M.lexicon_hits(d, twice).collect()] == [("chairman", "first")] * 2
    assert M.document_lookup(d, twice).count() == 2


def test_joined_hits_are_those_of_a_search_per_term(docs, lexicon):
    entries = [(t, "biased", [], "", "") for t in ("he", "The", "the end", "end", "é", "x-y", "c++", "(he)", "of  the", "never")]
    texts = ("He said the end, the END of  the x-y and c++ (he) é été.", "the", "", None, "the\nend of the", "hehe the_end x - y İ he", "x(he)x, c++x")
    found = {(r.doc_id, r.char_start, r.char_end, r.term) for r in M.joined_lexicon_hits(docs(*texts), lexicon(*entries)).collect()}
    want = set()
    for i, text in enumerate(texts):
        for t, *_ in entries:
            for m in re.finditer(rf"\b{re.escape(t)}\b", text or "", re.I):
                want.add((i, *m.span(), t.lower()))
    assert found == want and len(want) > 10
    assert M.joined_lexicon_hits(docs(*texts), lexicon(*entries).limit(0)).count() == 0
    again = lexicon(*entries).union(lexicon(*entries))
    assert M.joined_lexicon_hits(docs(*texts), again).count() == len(want)


def test_hits_of_one_term_do_not_overlap(docs, lexicon):
    lex = lexicon(("a a", "x", [], "", ""), ("a", "y", [], "", ""))
    d = docs("a a a", "a A a a", "aa a")
    for found in (M.joined_lexicon_hits(d, lex), M.joined_lexicon_hits(d, lex, block_chars=70), M.document_lookup(d, lex), M.lexicon_lookup(P.chunk_table(d), lex, max_terms=1)):
        assert sorted((r.doc_id, r.char_start) for r in found.filter("term = 'a a'").collect()) == [(0, 0), (1, 0), (1, 4)]


def test_a_vocabulary_beyond_the_patterns_gives_the_same_hits(docs, lexicon):
    words = ("he", "The", "the end", "end", "é", "x-y", "c++", "(he)", "of  the", "never", "end of", "the the", "İx", "man", "man-hours")
    lex = lexicon(*[(w, "biased", [w], "", "") for w in words])
    d = docs("He said the end, the END of  the x-y and c++ (he) é été.", "the the the end of", "", None, "x(he)x, c++x man-hours MAN", "İİ he man İ x(he)x end")
    for size in (1, 2, 4, 500):
        want = {tuple(r[:4]) for r in M.lexicon_hits(d, lex, batch_size=size).collect()}
        got = [tuple(r[:4]) for r in M.lexicon_hits(d, lex, batch_size=size, max_pattern_terms=3).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 15, size
        assert {tuple(r[:4]) for r in M.sliced_lexicon_hits(d, lex, slices=3, batch_size=size).collect()} == want


def test_sixty_thousand_terms(spark, docs):
    schema = "ord int, term string, category string, alternatives array<string>, note string, condition string, source string"
    lex = spark.range(60_000).selectExpr("CAST(id AS INT) AS ord", "concat('term', id, IF(id % 7 = 0, '!', '')) AS term", "'c' AS category", "array('x') AS alternatives", "'' AS note", "'' AS condition", "'s' AS source")
    d = docs("term5 Term14! term14!x term59999 term60000", "term1term2 term3")
    want = {(0, "term5"), (0, "term14!"), (0, "term59999"), (1, "term3")}
    for found in (M.lexicon_hits(d, lex), M.joined_lexicon_hits(d, lex)):
        assert {(r.doc_id, r.term) for r in found.collect()} == want
