"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of 1 to 3 code points are hashed to ``BUCKETS``
features. Document frequencies are counted over all training rows. The weights are learned by follow-the-regularised-leader with
elastic-net penalties (per-coordinate rates; weights whose gradient sum stays below ``L1`` are exactly zero). Rows that training
does not see set one temperature for the logits.

Training reads a bounded sample: about ``MAX_TRAIN`` rows, as many of each language as there are, chosen by a hash of the id. The
model has at most ``BUCKETS`` weights per language and is sent to the tasks.

Defined cases: null texts and texts without letters are ``und`` with score 0; null languages are not learned from; without any
language to learn all texts are ``und``; repeated rows are judged alike; ids that are null belong to no held-out fold; very long
texts are read whole, in slices; an empty table gives no rows; documents keep all columns, the result is one struct column whose
name does not clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_id, fresh, table, unit_hash

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
MAX_TRAIN = 6000
CALIBRATION_SHARE = 0.2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without letters."""
    total, letters, tail = None, False, np.array([32], np.uint32)
    for i in range(0, len(text), SLICE):
        part = np.frombuffer(text[i : i + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        part = np.where(_letters()[part], part, np.uint32(32))
        if i + SLICE >= len(text):
            part = np.append(part, np.uint32(32))
        run = np.concatenate((tail, part))
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != 32) | (run[:-1] != 32)
        run = run[keep]
        letters = letters or bool((run != 32).any())
        seen = len(tail)
        # n-grams that end in this slice; the tail holds the code points before it
        two = run[:-1] * np.uint32(0x01000193) + run[1:]
        three = two[:-1] * np.uint32(0x01000193) + run[2:]
        grams = np.concatenate((run[seen:], two[max(0, seen - 1) :] ^ np.uint32(0x9E3779B9), three[max(0, seen - 2) :] ^ np.uint32(0x7F4A7C15)))
        slot = (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        counts = np.bincount(slot, minlength=BUCKETS)
        total = counts if total is None else total + counts
        tail = run[-2:]
    return total if letters else None


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and unit-length TF-IDF weights; None for a text without letters."""
    counts = gram_counts(text) if text else None
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    return at.astype(np.int32), (values / max(float(np.linalg.norm(values)), 1e-12)).astype(np.float32)


def document_frequencies(rows: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of rows with letters, and how many of them have each feature; one partial count per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                counts = gram_counts(x.as_py() or "")
                if counts is not None:
                    n += 1
                    df += counts > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["slot", "df"])

    parts = rows.select(F.col(text).alias("text")).mapInArrow(count, "slot int, df long")
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in parts.groupBy("slot").agg(F.sum("df").alias("df")).collect():
        if r["slot"] < 0:
            n = r["df"]
        else:
            df[r["slot"]] = r["df"]
    return n, df


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (classes, features + 1); the last feature is a constant."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, at, x in rows:
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            logits = w @ x
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            g = p[:, None] * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[:, at] = zi + g - sigma * w
            n[:, at] = ni + g * g
    return weights(z, n)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> dict:
    """The model from rows where ``train`` holds: classes, idf, sparse weights, temperature."""
    rows = docs.filter(train & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    names = sorted(sizes)
    if not names:
        return {"classes": [], "idf": np.zeros(BUCKETS), "weights": np.zeros((0, BUCKETS + 1)), "temperature": 1.0}
    n, df = document_frequencies(rows, text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    share = max(1, max_train // len(names))
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, share / sizes[k])))])[F.col(lang)]
    held = unit_hash(F.lit("calibrate"), F.col(doc_id)) < CALIBRATION_SHARE
    chosen = rows.filter(unit_hash(F.lit("train"), F.col(doc_id)) < rate).select(F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held"))
    index = {k: i for i, k in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, k, h in zip(batch["text"], batch["lang"], batch["held"], strict=True):
                found = features(t.as_py(), idf)
                if found:
                    out.append((index[k.as_py()], h.as_py(), found[0].tobytes(), found[1].tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["label", "held", "slots", "weights"])

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(tuple(r.values()) for batch in batches for r in batch.select(["slots", "weights", "label", "held"]).to_pylist())
        order = np.random.default_rng(7).permutation(len(got))
        one = lambda s, w: (np.append(np.frombuffer(s, np.int32), BUCKETS), np.append(np.frombuffer(w, np.float32), 1.0))
        seen = [(got[i][2], *one(*got[i][:2])) for i in order if not got[i][3]]
        kept = [(got[i][2], *one(*got[i][:2])) for i in order if got[i][3]]
        w = train_ftrl(seen, len(names))
        t = temperature_of(np.array([w[:, at] @ x for _, at, x in kept]).reshape(-1, len(names)), np.array([k for k, _, _ in kept], int))
        c, f = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(c, -1), pa.int32()), pa.array(np.append(f, 0), pa.int32()), pa.array(np.append(w[c, f], t), pa.float64())], ["c", "f", "w"]
        )

    encoded = chosen.mapInArrow(encode, "label int, held boolean, slots binary, weights binary")
    weights, temperature = np.zeros((len(names), BUCKETS + 1)), 1.0
    for r in encoded.repartition(1).mapInArrow(train_all, "c int, f int, w double").collect():
        if r["c"] < 0:
            temperature = r["w"]
        else:
            weights[r["c"], r["f"]] = r["w"]
    return {"classes": names, "idf": idf, "weights": weights, "temperature": temperature}


def predict_one(text: str | None, model: dict, by_feature: np.ndarray) -> tuple[str, float]:
    found = features(text, model["idf"]) if model["classes"] else None
    if found is None:
        return UNKNOWN, 0.0
    logits = (found[1] @ by_feature[found[0]] + by_feature[BUCKETS]) / model["temperature"]
    p = np.exp(logits - logits.max())
    best = int(p.argmax())
    return model["classes"][best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: dict, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct ``lang_pred, score``, and the name of that column."""
    slim = {k: v for k, v in model.items() if k != "weights"}
    f, c = np.nonzero(model["weights"].T)
    w = model["weights"][c, f]

    @F.arrow_udf(T.StructType().add("lang_pred", "string").add("score", "double"))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_feature = np.zeros((BUCKETS + 1, len(slim["classes"])))
        by_feature[f, c] = w
        for batch in batches:
            got = [predict_one(x.as_py(), slim, by_feature) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    name = fresh(docs, "language")
    return docs.withColumn(name, judge(F.col(text))), name


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold_id(doc_id, 4) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; a quarter of them, by id, is never learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    judged, name = predict(docs.drop("lang"), model)
    return judged.select("doc_id", held_out().alias("held_out"), f"{name}.lang_pred", f"{name}.score")
