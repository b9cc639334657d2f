import hashlib
import random

from pyspark.sql import functions as F

from spanloom.llm import suffixes, winnow


def brute_ranges(texts, length):
    """Merged spans per text from all windows of all texts."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    spans = [[] for _ in texts]
    for i, s in sorted(p for places in seen.values() if len(places) > 1 for p in places):
        if spans[i] and s <= spans[i][-1][1]:
            spans[i][-1][1] = s + length
        else:
            spans[i].append([s, s + length])
    return spans


def test_maximal_repeats_cover_what_brute_force_finds():
    rnd = random.Random(6)
    for n in range(60):
        length = rnd.choice((8, 9, 20, 33))
        base = [bytes(rnd.choices(b"ab" if n % 2 else b"abcdefgh\x00", k=rnd.randint(1, 120))) for _ in range(5)]
        texts = base + [base[0][:50] + b"zz" + base[1][3:60], base[2] * 3, b"", base[3]]
        covered = [set() for _ in texts]
        for size, places in suffixes.maximal_repeats(texts, length):
            assert size >= length and len(places) > 1
            assert len({texts[c][s : s + size] for c, s in places}) == 1
            word = texts[places[0][0]][places[0][1] : places[0][1] + size]
            every = [(c, s) for c, t in enumerate(texts) for s in range(len(t) - size + 1) if t[s : s + size] == word]
            assert sorted(places) == every  # all occurrences
            assert len({texts[c][s - 1 : s] if s else (c,) for c, s in places}) > 1 or any(s == 0 for _, s in places)
            for c, s in places:
                covered[c] |= set(range(s, s + size))
        want = [{x for a, b in spans for x in range(a, b)} for spans in brute_ranges(texts, length)]
        assert covered == want


def test_equal_windows_choose_equal_anchors():
    rnd = random.Random(1)
    part = bytes(rnd.choices(range(256), k=900))
    a, b = bytes(rnd.choices(range(256), k=300)) + part, part + bytes(rnd.choices(range(256), k=500))
    at = lambda raw: {s: (anchor, place - s) for f, l, anchor, _, place in zip(*winnow.runs_of(raw, 400, 128)) for s in range(f, l + 1)}  # noqa: E731, E741
    x, y = at(a), at(b)
    assert all(x[300 + s] == y[s] for s in range(501)) and len(x) == len(a) - 399


def test_slices_do_not_change_the_anchors(monkeypatch):
    raw = bytes(random.Random(2).choices(b"abc", k=5000))
    places = lambda: {s: (int(h), int(p)) for f, l, h, _, p in zip(*winnow.runs_of(raw, 400, 128)) for s in range(f, l + 1)}  # noqa: E731, E741
    whole = places()
    monkeypatch.setattr(winnow, "SLICE", 333)
    assert places() == whole


def check(spark, texts, hot):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kid", F.lit("clash")).repartition(3)
    raw = [(t or "").encode() for t in texts]
    want = brute_ranges(raw, 400)
    for r in suffixes.remove_repeats(docs, hot=hot).collect():
        i = r["doc_id"]
        assert [[s["start"], s["end"]] for s in r["spans"]] == want[i], (hot, i)
        left, last = b"", 0
        for s, e in want[i]:
            left, last = left + raw[i][last:s], e
        left += raw[i][last:]
        assert r["n_bytes"] == len(raw[i]) and hashlib.sha256(r["kept"]).digest() == hashlib.sha256(left).digest()


def test_documents_against_brute_force(spark):
    rnd = random.Random(9)
    prose = lambda n: "".join(rnd.choices("abcdefgh é\n", k=n))
    long, passage = prose(3000), prose(450)
    edited = list(long)
    for i in (700, 1500, 1501, 2600):
        edited[i] = "#"
    texts = [
        long, long, "".join(edited), prose(600) + passage + prose(300), passage + prose(50), prose(20) + passage, prose(398) + long[:399], long[1000:1400] + prose(5),
        "x" * 1500, "x" * 399, "x" * 400, "", None, prose(5000), "ab" * 700, prose(100) + "x" * 420, passage[:390], long[-420:] + long[:420],
    ]
    check(spark, texts, suffixes.HOT)
    check(spark, texts, 1)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "q"), (1, "other")], "doc_id long, text string")
    got = sorted((len(r["kept"]), len(r["spans"])) for r in suffixes.remove_repeats(docs).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (5, 0)]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    passage = "".join(random.Random(8).choices("abcdef ", k=700))
    docs = spark.createDataFrame([(i, f"{i} " * i + passage + f" {i}" * 200) for i in range(20)], "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = suffixes.remove_repeats(docs)
        assert sum(len(r["spans"]) > 0 for r in done.collect()) == 20
        plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "ReusedExchange" in plan
