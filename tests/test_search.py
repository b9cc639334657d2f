import random

from spanloom.functions.terms import found_terms
from spanloom.operators import retrieval as G


def corpus(spark, n=12):
    long = "x " * 3000
    rows = [(f"d{i}", f"t{i}", f"{long} license {i}" if i % 2 else "nothing here", "T", "2020") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, title string, description string, peerreviewed string, year string")


def test_matches_far_into_the_text_are_found_and_blank_requests_have_no_answer(spark):
    asked = [
        {"request_id": 1, "phrases": ["license"], "any_of": [], "min_year": None},
        {"request_id": 2, "phrases": [' "():" '], "any_of": ["[]"], "min_year": None},
    ]
    got = G.search_ladder(asked, corpus(spark), k=20).collect()
    assert {r.request_id for r in got} == {1} and len(got) == 6
    assert G.search_ladder([], corpus(spark)).count() == 0
    assert len(G.simple_search_rerank([(1, "license")], corpus(spark), k=6).collect()) == 6


def test_one_document_with_most_of_the_best_vectors_hides_no_other(spark):
    rows = [(f"v{i}", i, [1.0, i / 10000], "hot" if i < 200 else f"d{i}") for i in range(210)]
    vectors = spark.createDataFrame(rows, "id string, ord long, embedding array<double>, doc_key string")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.doc_key for r in G.topk_by_doc(queries, vectors, 3).orderBy("rank").collect()] == ["hot", "d200", "d201"]


def plain_ladder(requests, docs, k):
    """Request by request over the documents, with substring tests; the ids of the rung that answers."""
    clean = lambda ts: [t for t in ("".join(c for c in x if c not in '"():[]').strip().lower() for x in ts) if t]
    out = {}
    for i, phrases, any_of, year in requests:
        p, a = clean(phrases), clean(any_of)
        some = [v for t in a for v in ([t] if " " in t or t.endswith("s") else [t, t + "s"])]
        words = [w for x in p for w in x.split()] + a
        if not words:
            continue
        relaxed = [d for d in docs if all(x in d[2].lower() for x in p) and (not some or any(x in d[2].lower() for x in some))]
        strict = [d for d in relaxed if d[3] == "T" and (not year or year <= int(d[4]) <= 2026)]
        rungs = [strict, relaxed, [d for d in docs if any(w in d[2].lower() for w in words)]]
        found = next(((n, r) for n, r in enumerate(rungs, 1) if len(r) >= 3), None)
        if found:
            out[i] = (found[0], {d[0] for d in found[1]}) if len(found[1]) <= k else (found[0], None)
    return out


def test_thousands_of_requests_are_a_table(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    docs = [(f"d{i:03}", "t", " ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=8)), rng.choice("TF"), str(rng.randrange(1990, 2030))) for i in range(90)]
    requests = [(i, [" ".join(rng.choices(words, k=rng.choice([1, 2]))) for _ in range(rng.choice([0, 1, 2]))], rng.choices([*words, '"x"', "():"], k=rng.choice([0, 1, 2])), rng.choice([None, 0, 2010])) for i in range(5000)]
    corpus = spark.createDataFrame(docs, "doc_id string, title string, description string, peerreviewed string, year string")
    asked = spark.createDataFrame(requests, "request_id int, phrases array<string>, any_of array<string>, min_year int")
    got = {}
    for r in G.search_ladder(asked, corpus, k=50, block_chars=40_000).select("request_id", "rung", "doc_id").collect():
        got.setdefault(r.request_id, (r.rung, set()))[1].add(r.doc_id)
    want = plain_ladder(requests, docs, 50)
    assert got.keys() == want.keys()
    assert all(got[i][0] == n and (ids is None or got[i][1] == ids) for i, (n, ids) in want.items())
    assert {n for n, _ in want.values()} == {1, 2, 3}


def test_terms_are_found_in_blocks(spark):
    rows = spark.createDataFrame([(1, "abcab", "x"), (2, None, "y"), (3, "", "z"), (4, "é€𝄞 abc", "w")], "id int, text string, term2 string")
    terms = spark.createDataFrame([(t,) for t in ("ab", "bc", "abc", "€𝄞", "zz")], "term string")
    for block in (10, 10_000):
        assert {tuple(r) for r in found_terms(rows, "text", ["id"], terms, block).collect()} == {(1, "ab"), (1, "bc"), (1, "abc"), (4, "ab"), (4, "bc"), (4, "abc"), (4, "€𝄞")}
    assert found_terms(rows, "text", ["id"], terms.limit(0)).count() == 0
