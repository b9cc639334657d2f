import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import collocations
from spanloom.llm.automata import DEPTH, CountAutomaton


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(rows, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(k == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (k, v), b in cand.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)}


def got(spark, rows, schema="lang string, text string", **args):
    found = collocations.collocations(spark.createDataFrame(rows, schema), **args)
    return {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def corpus(rng, n=120):
    vocabulary = [*"abcdefgh", "the", "The", "é", "ß", "x\x1fy", "ünder", " "]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("en", " \t "), ("fr", "one word"), ("en", "the the the the " * 20), ("en", "the the the the " * 20)]


@pytest.mark.parametrize("args", [{}, {"range_bytes": 200, "shard_words": 37}])
def test_equals_plain_counting(spark, monkeypatch, args):
    monkeypatch.setattr(collocations, "_STRIDE", 2)
    rows = corpus(random.Random(9))
    assert got(spark, rows, least=4, percent=50, top=60, **args) == plain(rows, 4, 50, 60)


def test_hot_words_spread_over_ranges_and_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["the", "of", f"w{rng.randrange(50)}"]) for _ in range(400_000))
    rows = [("en", long), ("en", long[:3000])]
    assert got(spark, rows, least=10, top=30, shard_words=150_000, range_bytes=1 << 16) == plain(rows, 10, 50, 30)
    texts = spark.createDataFrame(rows, "lang string, text string")
    bounds = collocations.cut_ranges(texts, 1 << 14)
    assert len({w[1] for k, w in bounds if w[0] == b"the"}) > 3  # the n-grams of one word are in many ranges


def test_counts_beyond_64_bits_are_exact(spark, monkeypatch):
    monkeypatch.setattr(collocations, "look_up", lambda requests, counts, bounds: requests.selectExpr("lang", "part", "n", "CAST(9000000000000 AS LONG) AS f"))
    monkeypatch.setattr(collocations, "phrases_of", lambda counts: spark.createDataFrame([("en", "a b", 2, 8_999_999_999_999)], "lang string, phrase string, words int, a long"))
    ((*_, score),) = got(spark, [("en", "a b")])
    assert score == 10**6 * 8_999_999_999_999**2 // 9_000_000_000_000**2


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == set()
    rows = [("en", "a b " * 30, 1, 2, 3, 4, "x")]
    assert got(spark, rows, "lang string, text string, rank int, n int, k int, a int, phrase string") == plain([r[:2] for r in rows], 10, 50, 2000)


def automaton(grams):
    words = sorted({w for g in grams for w in g})
    rows = np.array([[*(words.index(w) for w in g), *[-1] * (DEPTH - len(g))] for g in sorted(grams)], np.int64).reshape(-1, DEPTH)
    return CountAutomaton.from_sorted(words, rows, np.array([grams[g] for g in sorted(grams)], np.int64))


def spelled(a):
    rows, weights = a.expand()
    return {tuple(a.words[i] for i in r if i >= 0): w for r, w in zip(rows.tolist(), weights.tolist(), strict=True)}


def test_automata_keep_unite_and_compose_counts():
    rng = random.Random(1)
    draw = lambda n: Counter(tuple(rng.choice([b"a", b"b", b"c", b"\xc3\xa9", b"dd"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))
    parts = [draw(n) for n in (0, 1, 5, 60, 300)]
    for p in parts:
        a = CountAutomaton.from_bytes(automaton(p).to_bytes())
        assert spelled(a) == p
    united, total = CountAutomaton.union([automaton(p) for p in parts], 3)
    summed = sum(parts, Counter())
    assert spelled(united) == {k: v for k, v in summed.items() if v >= 3} and total == sum(v for k, v in summed.items() if len(k) == 1)
    wanted = dict.fromkeys([*draw(80), (b"nowhere",), (b"a", b"nowhere")], 1)
    answers = united.compose(automaton(wanted)).tolist()
    assert answers == [spelled(united).get(g, 0) for g in sorted(wanted)]
    assert CountAutomaton.union([automaton(Counter())])[0].compose(automaton({(b"a",): 1})).tolist() == [0]


def test_equal_states_are_stored_once():
    grams = {(a, b, c): 1 for a in (b"p", b"q", b"r") for b in (b"s", b"t") for c in (b"u", b"v")}
    a = automaton(grams)
    assert len(a.arcs[2][0]) == 2 and spelled(a) == grams
