import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import candidates as C
from spanloom.operators import retrieval as G
from spanloom.operators.passages import place_passages


def plain(texts, passages, loose):
    """Every passage in every text, one after the other."""
    out = []
    for d, t in texts:
        for i, p in passages:
            if t is None or not p or not p.split():
                continue
            at = t.find(p)
            if at >= 0:
                out.append((d, i, at, at + len(p)))
            elif loose:
                m = re.search(r"\s+".join(re.escape(w) for w in p.split()), t)
                out += [(d, i, m.start(), m.end())] if m else []
    return sorted(out)


def tables(spark, texts, passages):
    rows = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, item_id string")
    return rows, spark.createDataFrame([(i, p, 7) for i, p in passages], "item_id long, text string, doc_id int")


def test_passages_are_where_a_plain_search_finds_them(spark):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "é€", "𝄞x", "d.", "(e)", "ff"]
    texts = [(i, "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in rng.choices(words, k=rng.randrange(60)))) for i in range(60)]
    texts += [(70, None), (71, ""), (72, " \n "), (5, texts[5][1]), (73, "z" * 50_000 + " a bb ccc ff a bb ccc ff")]
    passages = []
    for i in range(150):
        t = rng.choice(texts[:60])[1]
        a = rng.randrange(len(t) + 1)
        cut = t[a : a + rng.randrange(40)]
        passages.append((i, cut if i % 2 else " ".join(cut.split())))
    passages += [(900, None), (901, ""), (902, " "), (903, "not in any of the texts at all"), (904, passages[0][1]), (905, "z a bb ccc ff a bb ccc f")]
    for loose in (False, True):
        got = sorted(tuple(r) for r in place_passages(*tables(spark, texts, passages), loose=loose).collect())
        assert got == plain(texts, passages, loose)
        assert len({i for _, i, *_ in got}) > 80


def test_tens_of_thousands_of_passages(spark):
    texts = [(i, f"start of {i} with some words that all the texts share and then {i * i} the end of it") for i in range(40)]
    passages = [(i, f"of {i} with some words that all the texts share and then {i * i} the end") for i in range(25_000)]
    got = place_passages(*tables(spark, texts, passages)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(40)}


def test_no_passages_and_no_texts(spark):
    rows, passages = tables(spark, [(1, "some words of a text are here")], [(1, "words of a text")])
    assert place_passages(rows.limit(0), passages).count() == 0
    assert place_passages(rows, passages.limit(0)).count() == 0


def test_a_document_with_twenty_thousand_candidates_meets_its_sentences(spark):
    rng = random.Random(5)
    spans, at = [], 3
    for _ in range(5_000):
        n = rng.randrange(1, 30)
        spans.append((at, at + n))
        at += n + rng.randrange(3)
    points = [rng.randrange(at + 10) for _ in range(20_000)]
    df = spark.createDataFrame([(spans, points), ([], [4]), (None, [4])], "spans array<struct<char_start:int,char_end:int>>, points array<int>")
    held = df.select(F.transform("points", lambda p: C.span_holding(F.col("spans"), p)).alias("held")).collect()
    starts = np.array([a for a, _ in spans])
    for p, h in zip(points, held[0].held):
        i = int(np.searchsorted(starts, p, side="right")) - 1
        assert (h and tuple(h)) == (spans[i] if i >= 0 and p < spans[i][1] else None)
    assert held[1].held == [None] and held[2].held == [None]


def test_best_groups_of_many_queries_in_rounds(spark):
    rng = random.Random(8)
    base = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(40)]
    rows = [(i, 1000 - i, base[i % 40], rng.choice(["hot", "hot", f"d{i % 25}", None])) for i in range(400)]
    asked = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(90)] + [(90, [0.0] * 4)]
    v = spark.createDataFrame(rows, "id int, ord long, embedding array<double>, doc_key string").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>")

    def cos(a, b):
        dot = lambda x, y: sum(s * t for s, t in zip(x, y))
        return dot(a, b) / ((dot(a, a) ** 0.5 or 1.0) * (dot(b, b) ** 0.5 or 1.0))

    want = set()
    for n, e in asked:
        best = {}
        for i, o, x, d in sorted(rows, key=lambda r: (-round(cos(e, r[2]), 10), r[1])):
            best.setdefault(d or str(i), o)
        want |= {(n, o, r) for r, o in enumerate(list(best.values())[:3], 1)}
    one = {(r.query_id, r.ord, r["rank"]) for r in G.topk_by_doc(q, v, 3).collect()}
    rounds = {(r.query_id, r.ord, r["rank"]) for r in G.topk_by_doc(q, v, 3, max_broadcast=0).collect()}
    assert one == rounds == want

    from spanloom.functions.vectors import top_k

    plain = {(r.query_id, r.ord, r["rank"]) for r in top_k(q, v, 5).collect()}
    assert plain == {(r.query_id, r.ord, r["rank"]) for r in top_k(q, v, 5, max_broadcast=0, block_rows=20).collect()}
    assert len(plain) == 5 * 91
