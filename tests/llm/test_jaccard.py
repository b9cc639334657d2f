import random

import numpy as np
import pytest

from spanloom.llm import jaccard


def shingles(text, size=3):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent=90, size=3):
    """Every pair, then components by repeated merging."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    return sorted(((d, len(s), d if not s else first.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def got(spark, rows, **args):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard.jaccard_components(docs, **args).select("doc_id", "n", "component_id").collect()), key=str)


def corpus(rng, n=260):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=45)
    rows = []
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 20, 45, 46, 60, 64, 65, 90, 130, 200]))
        if rng.random() < 0.3:
            base = base[:20] + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] if rng.random() < 0.7 else []
                copy = copy or ["x"]
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.1 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("args", [{}, {"hot_key": 2, "block_sets": 3, "block_tokens": 500}])
def test_components_equal_those_of_all_pairs(spark, args):
    rows = corpus(random.Random(11))
    rows += [(None, rows[5][1]), (900, rows[5][1]), (900, rows[5][1]), (901, None), (902, ""), (903, " \n\t"), (None, None), (904, "a"), (905, "A"), (906, "a b"), (None, "only here")]
    assert got(spark, rows, **args) == brute(rows)


def test_dropped_keys_are_paid_for_by_neighbourhoods(spark):
    """Sets that share whole segments without being alike: keys go, links stay."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(14)]
    rows = []
    for i in range(60):
        own = [f"u{i}x{k}" for k in range(30)]
        rows.append((2 * i, " ".join(shared + own)))
        own[rng.randrange(30)] = "changed" if i % 3 else own[0]
        rows.append((2 * i + 1, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = jaccard.Levels(80)
    prints = jaccard.set_prints(docs, "doc_id", "text", levels, 1)
    entries = prints.selectExpr("sid", "level AS at", "m AS segments", "explode(slice(keys, 1, m)) AS key")
    keys = entries.groupBy("key").agg({"sid": "count"}).withColumnRenamed("count(sid)", "n")
    dropped, around = jaccard.allocate(docs, prints, entries, keys, "doc_id", "text", levels, 1, 3)
    assert dropped.count() > 0 and around.count() > 0
    assert got(spark, rows, percent=80, size=1, hot_key=3) == brute(rows, 80, 1)


def test_segments_admit_every_linked_pair():
    levels = jaccard.Levels()
    for n in [*range(1, 400), 5000, 77_777]:
        level, reach = levels.of(n)
        assert levels.starts[level] <= n < levels.starts[level + 1]
        largest = n * 100 // 90
        assert largest < levels.starts[level + 1] or (reach and largest < levels.starts[level + 2])
        assert all(100 * (n + r) * 10 // 190 // 100 < levels.segments(levels.of(r)[0]) for r in (n, largest))


def test_forest_spans_what_is_linked():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(50)]
    for within in (True, False):
        first = np.arange(50) < 20
        edges = jaccard.forest(sets, first, 60, within)
        group = list(range(50))
        for i in range(50):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if (within or first[i] != first[j]) and 100 * inter >= 60 * (len(sets[i]) + len(sets[j]) - inter):
                    group = [group[j] if g == group[i] else g for g in group]
        mine = list(range(50))
        for a, b in edges:
            mine = [mine[b] if g == mine[a] else g for g in mine]
        assert len(edges) < 50 and [group.index(g) for g in group] == [mine.index(g) for g in mine]


def test_empty_tables_long_texts_and_further_columns(spark):
    assert got(spark, []) == []
    long = " ".join(f"t{i % 70_000}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 3_000_000)]
    assert got(spark, rows) == [(1, 70_000, 1), (2, 70_001, 1), (3, 1, 3)]
    docs = spark.createDataFrame([(7, "a b c d", 1, 2, 3, 4)], "doc_id long, text string, n long, sid long, key long, root long")
    assert [tuple(r) for r in jaccard.jaccard_components(docs).collect()] == [(7, 2, 7)]


def test_sketches_keep_every_link_and_part_most_others():
    rnd = np.random.default_rng(3)
    for n, percent in ((30, 90), (300, 90), (300, 80), (3000, 90)):
        base = rnd.integers(0, 1 << 63, n, np.uint64)
        passage = base[: n // 2]
        sets = [base, *[np.unique(np.concatenate((np.delete(base, rnd.integers(0, n, k)), rnd.integers(0, 1 << 63, k, np.uint64)))) for k in (1, n // 50 + 1, n // 25 + 1) for _ in range(5)]]
        sets += [np.unique(np.concatenate((passage, rnd.integers(0, 1 << 63, n - len(passage), np.uint64)))) for _ in range(40)]
        first = np.arange(len(sets)) % 2 == 0
        sketches = [jaccard.sketch(s, n + n // 5, percent) for s in sets]
        for within in (True, False):
            root = list(range(len(sets)))
            for a, b in jaccard.sketch_forest(sketches, first, percent, within):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
            for a, b in jaccard.forest(sets, first, percent, within):
                assert root[a] == root[b]
            assert sum(r == i for i, r in enumerate(root)) > 30  # those that only share the passage stay apart
        assert n < 300 or max(len(s) for s in sketches) * 8 <= n
