"""The pipeline against a plain composition of brute-force versions."""

import math
import random
from hashlib import md5

import corpus_pipeline
import pyarrow as pa
from spanloom.llm import mixing
from test_contamination import brute as brute_hits
from test_pii import brute as brute_pii
from test_neardup import brute_kept

EN = "the and of that was with this from which shall have been there would their what about".split()
DE = "der die und nicht eine werden über für können würde auch nach zwischen große straße".split()


def corpus():
    rnd = random.Random(8)
    bench = [(i, " ".join(rnd.choices(EN, k=20))) for i in range(5)]
    rows = []
    for i in range(120):
        words = rnd.choices(EN if i % 3 else DE, k=60)
        text = " ".join(words)
        if i % 10 == 4:
            text += f". mail me{i}@example.org or +49 30 123456{i:03}"
        if i % 20 == 7:
            text += ". " + bench[i % 5][1].upper()
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}", len(text)))
    rows += [(180 + i, rows[i][1].rsplit(" ", 1)[0] + " and", rows[i][2], "s8", rows[i][4]) for i in range(3)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s9", rows[i][4]) for i in range(15)]
    rows += [(300, "12 34 !", "en", "s0", 7), (301, None, None, None, None), (302, "", "de", "s1", 0)]
    return rows, bench


def test_against_brute_force(spark, tmp_path):
    rows, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["copy"], r["text"], r["n_chars"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = {r[0]: r for r in rows if r[0] not in (300, 301, 302)}
    docs = {i: docs[i] for i in brute_kept(list(docs.values()))}
    items = [(str(i), t) for i, t in bench]
    docs = {i: r for i, r in docs.items() if not (brute_hits(r[1], items)[1] > 0 and 20 * brute_hits(r[1], items)[1] >= brute_hits(r[1], items)[0])}
    assert not any(i % 20 == 7 for i in docs)
    texts = {}
    for i, r in docs.items():
        text = r[1]
        for kind, a, b in sorted(brute_pii(text), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        texts[i] = text
    sizes = {}
    for i, r in docs.items():
        sizes[r[3]] = sizes.get(r[3], 0) + len(texts[i])
    weight, total = sum(math.sqrt(c) for c in sizes.values()), sum(sizes.values())
    want = []
    for i, r in docs.items():
        rate = math.sqrt(sizes[r[3]]) / weight * total / sizes[r[3]]
        n = 0
        parts = math.ceil(rate / mixing.PIECE)
        for j in range(1, parts + 1):
            u, k, p = int(md5(f"mix-1:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate / parts)
            c = p
            while u >= c:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        want += [(i, c, texts[i], len(texts[i])) for c in range(1, n + 1)]
    assert got == sorted(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    twice = spark.createDataFrame(rows[:3] * 2 + [(None, "a b c d", "en", "s", 7), (None, "e f g h i j", "en", "s", 11)], schema)
    assert corpus_pipeline.near_duplicate_stage(spark, twice, "").count() == 5


def test_unlabelled_documents_with_letters_stay(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(r[0], r[1], None, r[3], r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {300, 301, 302}


def test_stages_hand_texts_over_in_small_batches(spark, tmp_path):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "Some words of this text.") for i in range(1000)], "doc_id long, text string")
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    for given, most in ((None, 256), ("100", 100)):
        spark.conf.unset(conf) if given is None else spark.conf.set(conf, given)
        try:
            corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
            assert max(r["n"] for r in docs.coalesce(1).mapInArrow(count, "n long").collect()) == most
        finally:
            spark.conf.unset(conf)
