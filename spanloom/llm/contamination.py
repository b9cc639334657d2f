"""Benchmark decontamination with one Aho-Corasick automaton over the words of all test items.

Texts and items are lower-cased (A-Z) and cut into words. Every 13 consecutive words of an item are a window; a shorter item is one
window. The automaton is built over windows as sequences of word numbers, so it has one node per word, and each text runs through
it once, as the sequence of its own word numbers. Hits are word ranges; they are mapped to code points of the original text.

An automaton holds about ``BLOCK_CHARS`` characters of items, which bounds what the driver and a worker keep in memory. A larger
benchmark is dealt out by the hash of the item id and its blocks are read one after another: each is one pass over the texts, whose
narrow hits are written before the next block is read. The hits of a text are then merged and joined back; all items are always used.

Defined cases: null and empty texts have no words and are not contaminated; items without words are never found; repeated items
count by their ids; a null item id is an empty string; an empty benchmark leaves every text clean; all columns of the documents
are kept, and the result is one struct column whose name does not clash. Very long texts are handled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fits
from .common import bind, checkpointed, fresh, table

WINDOW = 13
BLOCK_CHARS = 1_000_000
#: Texts with hits that are broadcast; beyond it they meet the documents in a shuffle, with ``SALTS`` copies of each.
MAX_BROADCAST_TEXTS = 100_000
SALTS = 16
#: A document is contaminated when hits are at least one word in this many.
SHARE = 20

_LOWER = bytes(
    (i + 32) if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_RESULT = "struct<n_words:long,runs:array<struct<start:int,end:int>>,spans:array<struct<start:int,end:int>>,items:array<string>>"
_built: dict[int, tuple] = {}


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def automaton_of(items: list[tuple[str, str]], window: int = WINDOW):
    """(word numbers, automaton); each entry has the number of words and the ids of its items."""
    numbers: dict[bytes, int] = {}
    entries: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text.encode())]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            entries.setdefault(tuple(ids[i : i + window]), set()).add(item_id)
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in entries.items():
        made.add_word(key, (len(key), tuple(ids)))
    if entries:
        made.make_automaton()
    return numbers, made if entries else None


def scan(raw: bytes, numbers: dict[bytes, int], automaton) -> tuple[int, list, list, list]:
    words = words_of(raw)
    ids = tuple(map(numbers.get, words, (0,) * len(words)))
    marks, items = None, set()
    if automaton is not None and any(ids):
        for end, (size, found) in automaton.iter(ids):
            if marks is None:
                marks = np.zeros(len(words) + 2, dtype=np.int32)
            marks[end - size + 1] += 1
            marks[end + 1] -= 1
            items.update(found)
    if marks is None:
        return len(words), [], [], []
    hit = np.concatenate(([0], np.cumsum(marks)[: len(words)] > 0, [0])).astype(np.int8)
    edge = np.diff(hit)
    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    places = [m.span() for m in _WORD.finditer(raw.decode())]
    return len(words), runs, [(places[a][0], places[b - 1][1]) for a, b in runs], sorted(items)


def _scanner(items: list[tuple[str, str]], window: int):
    key = hash((tuple(items), window))

    @F.arrow_udf(_RESULT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _built:
            _built.clear()
            _built[key] = automaton_of(items, window)
        numbers, automaton = _built[key]
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kind = pa.struct([("n_words", pa.int64()), ("runs", pairs), ("spans", pairs), ("items", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for x in batch.cast(pa.binary()):
                n, runs, spans, ids = scan(x.as_py() or b"", numbers, automaton)
                rows.append({"n_words": n, "runs": [{"start": a, "end": b} for a, b in runs], "spans": [{"start": a, "end": b} for a, b in spans], "items": ids})
            yield pa.array(rows, kind)

    return found


def _merge(ranges):
    """Union of word or character ranges."""

    def grow(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(ranges), F.array().cast("array<struct<start:int,end:int>>"), grow)


def _blockwise(docs: DataFrame, items: DataFrame, text: str, name: str, window: int, blocks: int) -> tuple[DataFrame, Column]:
    """``docs`` with the hits of all blocks, merged per text, and the column that holds them."""
    th, kept = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), []
    for b in range(blocks):
        mine = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]
        hits = docs.select(th, _scanner(mine, window)(F.col(text)).alias("r")).filter(F.size("r.items") > 0)
        kept.append(checkpointed(hits.groupBy("th").agg(F.first("r").alias("r"))))
    of_text = reduce(DataFrame.unionByName, kept).groupBy("th").agg(F.collect_list("r").alias("rs"))  # one entry per block at most
    all_of = lambda f: F.flatten(F.col("rs")[f])
    merged = checkpointed(of_text.select("th", _merge(all_of("runs")).alias("runs"), _merge(all_of("spans")).alias("spans"), F.sort_array(F.array_distinct(all_of("items"))).alias("items")))
    key, salt, hit = fresh(docs, "text_hash"), fresh(docs, "text_salt"), fresh(docs, "text_hits")
    salts = 1 if fits(merged, MAX_BROADCAST_TEXTS) else SALTS
    side = merged.select(F.col("th").alias(key), F.struct("runs", "spans", "items").alias(hit), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.withColumns({key: th, salt: F.pmod(cells, F.lit(salts)).cast("int")})
    joined = rows.join(F.broadcast(side) if salts == 1 else side, [key, salt], "left")
    ranges = "array<struct<start:int,end:int>>"
    found = joined.withColumn(name, F.struct(
        _scanner([], window)(F.col(text))["n_words"].alias("n_words"), F.coalesce(F.col(hit)["runs"], F.array().cast(ranges)).alias("runs"),
        F.coalesce(F.col(hit)["spans"], F.array().cast(ranges)).alias("spans"), F.coalesce(F.col(hit)["items"], F.array().cast("array<string>")).alias("items"),
    ))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], name), F.col(name)


def find_benchmark(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """``docs`` with a struct column, and its name: ``n_words, n_hit, runs`` (words), ``spans`` (code points), ``items``."""
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(item_text, F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    name = fresh(docs, "benchmark_hits")
    if blocks == 1:
        found = docs.withColumn(name, _scanner([tuple(r) for r in items.collect()], window)(F.col(text)))
        merged = F.col(name)
    else:
        found, merged = _blockwise(docs, items, text, name, window, blocks)
    hit = bind(merged["runs"], lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]))
    return found.withColumn(name, F.struct(merged["n_words"].alias("n_words"), hit.alias("n_hit"), merged["runs"].alias("runs"), merged["spans"].alias("spans"), merged["items"].alias("items"))), name


def is_contaminated(found):
    return (found["n_hit"] > 0) & (SHARE * found["n_hit"] >= found["n_words"])


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found, name = find_benchmark(docs, table(spark, sf, "benchmark"))
    hits = F.col(name)
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(hits).alias("contaminated"),
    )


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_W} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
