import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import language as lang

SF = "/root/testdata/sf0.001"


def brute_grams(text):
    flat = "".join(c if c.isalpha() else " " for c in text.lower())
    flat = " " + " ".join(flat.split()) + " "
    return sum(max(0, len(flat) - n + 1) - (n == 1) for n in (1, 2, 3))  # the first space is context only


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Abc, dÉ 你好 x1y \n\U0001d4d0 ende" * 40
    whole = lang.gram_counts(text)
    assert whole.sum() == brute_grams(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(lang, "SLICE", size)
        assert (lang.gram_counts(text) == whole).all(), size
    assert lang.gram_counts("12 -- \n") is None


def test_penalty_makes_weights_sparse_and_training_separates(monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        y = i % 2
        at = np.append(np.unique(np.append(rng.integers(10, 500, 20), y)), lang.BUCKETS)
        rows.append((y, at, np.where(at < 2, 1.0, 0.1)))
    w = lang.train_ftrl(rows, 2)
    monkeypatch.setattr(lang, "L1", 0.0)
    assert np.count_nonzero(w) < 0.8 * np.count_nonzero(lang.train_ftrl(rows, 2)) and w[0, 0] > 0 > w[1, 0] and w[1, 1] > 0 > w[0, 1]


def test_temperature_softens_overconfident_logits():
    logits, labels = np.array([[9.0, 0.0]] * 100), np.array([0] * 80 + [1] * 20)
    t = lang.temperature_of(logits, labels)
    p = 1 / (1 + np.exp(-9 / t))
    assert abs(p - 0.8) < 0.01


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 34", "en"), (-3, "", None), (None, "the", None)], "doc_id long, text string, lang string")
    rows = docs.unionByName(odd).withColumn("language", F.lit(1))
    model = lang.fit(docs, ~lang.held_out())
    got, name = lang.predict(rows, model)
    assert name == "_language"
    out = got.select("doc_id", "lang", f"{name}.*").collect()
    held = {r["doc_id"] for r in docs.filter(lang.held_out()).collect()}
    tested = [r for r in out if r["doc_id"] in held]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.95 * len(tested)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] in (-1, -2, -3))
    assert all(0 <= r["score"] <= 1 for r in out)
    assert lang.predict(rows.limit(0), model)[0].count() == 0
    nothing = lang.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert lang.predict(rows, nothing)[0].select(f"{name}.lang_pred").distinct().first()[0] == "und"
