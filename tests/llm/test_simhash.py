import random

import xxhash
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.common import written

WS = " \t\n\x0b\f\r"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WS:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    texts = ["A b  C d\u00a0e", "one", "two Words", "", None, " \t\n", "\u00c9 \u00e9 x " * 50, "x" * 5000, "a b c " * 30000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def links(spark, values, hot):
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    return simhash.links_of(spark.createDataFrame(signed, "fp long"), hot)


def test_every_link_is_found_with_ordinary_and_hot_keys(spark):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            w = v
            for b in rnd.sample(range(64), rnd.choice((1, 2, 2, 3))):
                w ^= 1 << b
            values.add(w)
    values = sorted(values | {0, 1, 1 << 63, 2**64 - 1})
    want = {(a, b) for a in values for b in values if (a - 2**64 * (a >> 63)) < (b - 2**64 * (b >> 63)) and (a ^ b).bit_count() <= 2}
    got = {(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in links(spark, values, 1000).collect()}
    assert got == want
    classes = brute_components(dict(enumerate(values)))
    for hot in (1, 1000):
        roots = {r["fp"] & (2**64 - 1): r["root"] for r in simhash.components(links(spark, values, hot)).collect()}
        for i, v in enumerate(values):
            same = {roots.get(w, w) for j, w in enumerate(values) if classes[j] == classes[i]}
            assert len(same) == 1, (hot, v)
        assert len(set(roots.values())) == len({c for i, c in classes.items() if list(classes.values()).count(c) > 1})


def test_components_of_documents(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(12)]
    texts = base + [b.replace("w1 ", "w2 ", 1) for b in base] + base[:3] * 4 + ["", None, "  "]
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == brute_components({i: brute_print(t) for i, t in zip(ids, texts)})


def test_chain_of_links_is_followed(spark):
    values = [(1 << (2 * i)) - 1 for i in range(30)]  # each two bits from the next
    roots = {r["root"] for r in simhash.components(links(spark, values, 1000)).collect()}
    assert len(roots) == 1


def test_long_path_needs_few_rounds_and_its_size_estimate_stays_small(spark, monkeypatch):
    n, tables = 5003, []
    monkeypatch.setattr(simhash, "written", lambda df: tables.append(written(df)) or tables[-1])
    path = spark.range(n - 1).select((F.col("id") * 791 % n).alias("a"), ((F.col("id") + 1) * 791 % n).alias("b"))
    other = spark.createDataFrame([(n + 5, n + 2), (n + 2, n + 9)], "a long, b long")
    classes = simhash.components(path.union(other)).groupBy("root").count().collect()
    assert sorted(map(tuple, classes)) == [(0, n), (n + 2, 3)]
    assert len(tables) < 30
    assert tables[-1]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(7, "a b c d")] * 3 + [(None, "z y x")], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (7, 7), (7, 7), (7, 7)]
