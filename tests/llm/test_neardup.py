import random

from spanloom.llm import jaccard, neardup

SCHEMA = "doc_id long, text string, source string, lang string"


def shingles(text, size=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_kept(rows, percent=80):
    """Ids of the first row of each class of all pairs at or over the limit; texts without words are one class."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for r, g in zip(rows, group, strict=True):
        first[g] = min(r[0], first.get(g, r[0]))
    return sorted(first.values())


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(600)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 9, 30, 80, 150, 400]))
        if i % 4 == 0:
            base += passage
        for edits in rng.choice([[0], [0, 0], [0, 1, 2], [0, 2, 4, 6]]):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), f"s{i % 3}", "en"))
    rows += [(900, "", "s", "en"), (901, None, "s", "en"), (902, " \n", "s", "en")]
    kept = [r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept) == brute_kept(rows)


def test_recall_of_pairs_just_over_the_limit(spark):
    """Planted pairs with a similarity of 0.8 to 0.85: at least nine in ten must be found."""
    rng = random.Random(8)
    rows, pairs = [], []
    while len(pairs) < 60:
        a = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 200, 500]))]
        b = list(a)
        while len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b))) >= 0.85:
            b[rng.randrange(len(b))] = f"v{rng.randrange(5000)}"
        sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
        if len(sa & sb) / len(sa | sb) >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a), "s", "en"), (len(rows) + 1, " ".join(b), "s", "en")]
    kept = {r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {a for a, _ in pairs} <= kept and sum(b not in kept for _, b in pairs) >= 54


def test_copies_that_agree_in_a_crowded_segment_only(spark):
    """Every set has the same first segment; a copy differs from its original in all the others, below the limit for SimHash."""
    levels = neardup.Segments(80)
    level = levels.of(200)[0]
    n, m = levels.starts[level], levels.segments(level)
    known, fresh, number = jaccard._Hashes(), {s: [] for s in range(m)}, iter(range(10**9))

    def word(segment):
        while not fresh[segment]:
            w = f"q{next(number)}"
            fresh[int(jaccard.token_set(w.encode(), known, 1)[0]) % m].append(w)
        return fresh[segment].pop()

    common = [word(0) for _ in range(7)]
    rows = []
    for i in range(90):
        base = {s: [word(s) for _ in range((n - 7) // (m - 1) + (s <= (n - 7) % (m - 1)))] for s in range(1, m)}
        rows.append((len(rows), " ".join(common + sum(base.values(), [])), "s", "en"))
        if i % 9 == 0:
            for s in range(1, m, 2):
                base[s][0] = word(min(s + 1, m - 1))
            rows.append((len(rows), " ".join(common + sum(base.values(), [])), "copy", "en"))
    assert all(len(shingles(r[1], 1)) == n and not levels.of(n)[1] for r in rows)
    pairs = [(shingles(a[1], 1), shingles(b[1], 1)) for a, b in zip(rows, rows[1:], strict=False) if b[2] == "copy"]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in pairs)
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA), size=1).collect()
    assert sorted(r["doc_id"] for r in kept) == [r[0] for r in rows if r[2] == "s"]


def test_one_row_of_a_class_stays_whatever_else_differs(spark):
    same = [(1, "a b c d e", "s", None), (1, "a b c d e", None, "s"), (1, "a b c d e", "t", "en"), (1, "a b c d e", "t", "en")]
    rows = same + [(None, "v w x y z", s, "en") for s in ("p", "q", "r", None)] + [(None, "v w x y z", "p", "en")]
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"] for r in kept) == ["a b c d e", "v w x y z"]


def test_clashing_names_and_empty_table(spark):
    names = "keep_id long, th long, row string, root string, n int, text_hash int, row_hash int, sid int, fp int, id int"
    docs = spark.createDataFrame([(i, f"text {i // 2} b c d e f g", i, i, "r", "x", 1, 2, 3, 4, 5, 6) for i in range(4)], f"doc_id long, text string, {names}")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert neardup.keep_one(docs.limit(0)).count() == 0
