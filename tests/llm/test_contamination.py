import random
import re

from pyspark.sql import functions as F

from spanloom.llm import contamination as con

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_against_brute_force_with_one_and_many_automata(spark):
    rnd = random.Random(1)
    vocab = ["the", "Of", "é", "ß1", "x", "42"]
    items = [(str(i), ", ".join(rnd.choices(vocab, k=rnd.choice((0, 2, 13, 14, 20))))) for i in range(30)] + [("9", "the Of é"), ("x", None)]
    texts = [" ".join(rnd.choices(vocab, k=200)) for _ in range(10)] + [items[3][1] or "", None, "", "--", items[4][1] + " -- " + items[5][1].upper().replace("É", "é"), "a" * 10000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, benchmark_hits string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    for size in (10**6, 60):
        found, name = con.find_benchmark(docs, bench, block_chars=size)
        assert name != "benchmark_hits"
        for r in found.collect():
            h = r[name]
            assert (h["n_words"], h["n_hit"], h["items"]) == want[r["doc_id"]], (size, r["doc_id"])
            assert sum(len(words(texts[r["doc_id"]][s["start"] : s["end"]])) for s in h["spans"]) == h["n_hit"]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    found, name = con.find_benchmark(docs, bench)
    assert found.select(con.is_contaminated(F.col(name))).first()[0] is False
    assert con.find_benchmark(docs.limit(0), bench)[0].count() == 0


def test_blocks_are_read_one_by_one_and_joined_back(spark, monkeypatch):
    """Many blocks give what one automaton gives, with the joins broadcast or shuffled, repeated rows and clashing names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choices(words, k=rng.choice([3, 13, 20])))) for i in range(30)] + [(None, "lone item"), (31, None)]
    texts = [" ".join(rng.choices(words, k=30) + bench[rng.randrange(30)][1].split() + rng.choices(words, k=10)) for _ in range(40)] + ["", None, "lone item", "w1 " * 50_000]
    rows = [(i % 40, t, "a", 1, "h", "s") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, benchmark_hits string, th int, text_hash string, text_salt string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = None
    for chars, texts_broadcast in ((1_000_000, 100), (500, 100), (500, 0)):
        monkeypatch.setattr(con, "MAX_BROADCAST_TEXTS", texts_broadcast)
        found, name = con.find_benchmark(docs, items, block_chars=chars)
        assert found.columns == [*docs.columns, name]
        got = sorted((r["doc_id"], r["text"] or "", str(r[name].asDict(recursive=True))) for r in found.collect())
        want = want or got
        assert got == want and len(got) == len(rows)
