import random
from itertools import permutations

from spanloom.llm import audit

LONG = " ".join(f"w{i}" for i in range(60))


def plain(rows, labels):
    """Every order run step by step over the rows themselves."""
    failing = []
    for d, text, part in rows:
        t = text or ""
        w = t.split()
        failing.append((part or "", {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows),
        }, any(k == d and q == 1 for k, q, _ in labels if d is not None), any(k == d and x == 1 for k, _, x in labels if d is not None)))
    out, shapley = {}, {}
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                out_now = [f for f in left if f[1][name]]
                gone = [f for f in own if any(f[1][x] for x in order[: step - 1])]
                left = [f for f in left if not f[1][name]]
                out[part, "".join(order), step] = (
                    len(left), len(out_now), sum(f[1][name] for f in gone), sum(f[1][name] and sum(f[1].values()) == 1 for f in own),
                    sum(f[2] for f in out_now), sum(f[3] for f in out_now),
                )
                shapley[part, name] = shapley.get((part, name), 0) + len(out_now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        docs = docs.selectExpr("*", "1 AS part", "'x' AS hash", "2 AS size", "3 AS bits", "4 AS n", "5 AS salt")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return audit.audit_orders(audit.combinations(audit.failure_bits(docs), marks))


def test_matches_a_plain_run_of_all_orders(spark):
    rng = random.Random(3)
    bodies = [LONG, LONG + " x", LONG.upper(), "the cat " * 40, "short", "", None, "A#B " * 60, LONG + " 5%", "\x0b \t\n", "é" * 10 + " É", LONG + "\x1f\xa0a"]
    rows = [(i, rng.choice(bodies), rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(None, LONG, "a"), (None, LONG, "a"), (3, "doubled id", "a"), (3, "doubled id", "a"), (4, LONG, "b")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (6, None, 1)]
    for extra in (False, True):
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in run(spark, rows, labels, extra).collect()}
        assert got == plain(rows, labels)


def test_hot_copies_and_collisions_are_compared_by_text(spark):
    rows = [(i, "copy " * 60, "s") for i in range(400)] + [(1000 + i, f"{LONG} {i}", "s") for i in range(20)]
    got = [r for r in run(spark, rows, []).collect() if r["filter_order"] == "EABCD" and r["step"] == 1]
    assert [(r["kept"], r["removed"]) for r in got] == [(21, 399)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").selectExpr("*", "7L AS hash", "1 AS size")
    assert audit.earlier_copies(docs, docs.drop("text")).count() == 399  # all hashes equal: only the texts decide


def test_empty_table_and_very_long_text(spark):
    assert run(spark, [], []).count() == 0
    rows = [(1, "word " * 400_000, None), (2, "word " * 400_000, None)]
    got = {(r["part"], r["removed"]) for r in run(spark, rows, []).collect() if r["filter_order"] == "EABCD" and r["step"] == 1}
    assert got == {("", 1)}
