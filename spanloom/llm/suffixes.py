"""Substring dedup: maximal repeats from common-prefix intervals of an enhanced suffix array.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus. Equal windows choose equal anchors
(``winnow``), so windows are compared only within one anchor hash:

1. Runs of windows with one anchor are counted by (anchor hash, context hash). A context that occurs twice or more is a repeat as a
   whole; this settles copies of any number before anything is compared.
2. Anchors with several different contexts send one copy of each context to a suffix array. Adjacent suffixes get their common prefix
   lengths, a scan with a stack walks the tree of common-prefix intervals of at least ``LENGTH``, and each interval whose
   occurrences have different left neighbours (or start a context) is a maximal repeat with all its occurrences. Their union is exactly
   the set of repeated windows: a repeat that always has the same left neighbour is part of a longer one.
3. An anchor with more than ``HOT`` different contexts goes another exact way, which spreads it over the cluster: each window's two
   64-bit hashes are counted.

Texts meet their runs and repeats by a key of id and text hash. Both joins read the same columns of them, so one shuffle serves both.

Defined cases: null text is empty; texts below ``LENGTH`` bytes and texts without repeats stay whole; rows with equal id and text repeat each
other; null ids are ids like any other; very long texts are read in slices with the same result; an empty table gives no rows;
only id and text are read, so further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import winnow
from .common import checkpointed, table

LENGTH = 400
GRAM = 128
HOT = 4096
#: Bytes of contexts in one suffix array; an anchor's contexts stay together.
BATCH_BYTES = 1 << 20

_RANGE = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_PA_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def suffix_array(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts in lexicographic order of their suffixes, common prefixes with the one before (0 below ``length``), the byte
    before each (-1 at the start of a context), and the offsets of the contexts in the joined text.

    Suffixes end with their context. Ranks of prefixes double in length; a prefix of ``length`` is two overlapping ones.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    total, longest = len(data), int(sizes.max())
    left = np.repeat(offsets[1:], sizes) - np.arange(total)  # bytes to the end of the context
    at = np.arange(total)

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        fresh = np.empty(len(key), np.int64)
        fresh[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        return fresh

    def shifted(rank: np.ndarray, by: int, where: np.ndarray) -> np.ndarray:
        """Ranks ``by`` bytes on, 0 behind the end of the context."""
        return np.where(left[where] > by, rank[np.minimum(where + by, total - 1)], 0)

    key = np.zeros(total, np.uint64)
    for j in range(8):
        byte = np.zeros(total, np.uint64)
        byte[: total - j] = data[j:]
        key = (key << np.uint64(8)) | np.where(left > j, byte, np.uint64(0))
    ranks = {8: ranked(key)}
    size = 8
    while 2 * size <= length:
        r = ranks[size]
        ranks[2 * size] = ranked(r * (total + 1) + shifted(r, size, at))
        size *= 2
    starts = at[left >= length]
    r = ranks[size]
    whole = ranked(r[starts] * (total + 1) + shifted(r, length - size, starts))
    order, done = [whole], length
    while done < longest:  # what lies behind the first ``length`` bytes
        order.append(shifted(r, done, starts))
        done += size
    sa = starts[np.lexsort(order[::-1])]
    rank_of = whole[np.searchsorted(starts, sa)]
    same = np.flatnonzero(rank_of[1:] == rank_of[:-1])
    a, b, common = sa[same], sa[same + 1], np.full(len(same), length, np.int64)
    room = np.minimum(left[a], left[b])
    steps = [size] * (-(-longest // size)) + [s for s in (size // 2**i for i in range(1, 20)) if s >= 8]
    for s in steps:
        fits = common + s <= room
        x, y = np.minimum(a + common, total - 1), np.minimum(b + common, total - 1)
        common += np.where(fits & (ranks[s][x] == ranks[s][y]), s, 0)
    for _ in range(8):
        more = (common < room) & (data[np.minimum(a + common, total - 1)] == data[np.minimum(b + common, total - 1)])
        common += more
    lcp = np.zeros(len(sa), np.int64)
    lcp[same + 1] = common
    before = np.where(left[np.maximum(sa - 1, 0)] > 1, data[np.maximum(sa - 1, 0)].astype(np.int64), -1)
    before[sa == 0] = -1
    return sa, lcp, before, offsets


def maximal_repeats(contexts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(context number, start)]) of every repeat of at least ``length`` bytes that cannot be extended to the left."""
    if not contexts or max(map(len, contexts)) < length:
        return []
    sa, lcp, before, offsets = suffix_array(contexts, length)
    if not len(sa):
        return []
    # root intervals of the tree: stretches of suffixes with common prefixes of at least ``length``
    joined = lcp >= length
    first = np.flatnonzero(~joined & np.append(joined[1:], False))
    last = np.flatnonzero(joined & ~np.append(joined[1:], False))
    # places where the left neighbour changes; a context's start differs from all
    change = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    diverse = lambda i, j: before[i] < 0 or change[j] > change[i]
    out = []

    def add(size: int, lo: int, hi: int) -> None:
        if diverse(lo, hi):
            where = sa[lo : hi + 1]
            which = np.searchsorted(offsets, where, side="right") - 1
            out.append((size, list(zip(which.tolist(), (where - offsets[which]).tolist(), strict=True))))

    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if not diverse(lo, hi):
            continue
        stack: list[list[int]] = []  # [common prefix, left end] of the open intervals, the prefixes rising
        for i, size in enumerate([*lcp[lo + 1 : hi + 1].tolist(), 0], lo + 1):
            begin = i - 1
            while stack and stack[-1][0] > size:
                depth, begin = stack.pop()
                add(depth, begin, i - 1)
            if size >= length and (not stack or stack[-1][0] < size):
                stack.append([size, begin])
    return out


def _ranges(lists: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([x for r in lists for x in r], np.int32).reshape(-1, 2)
    ends = np.concatenate(([0], np.cumsum([len(r) for r in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])).cast(_PA_RANGE)


@F.arrow_udf(T.ArrayType(T.StructType().add("first", "integer").add("last", "integer").add("anchor", "long").add("context", "long")))
def runs_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        got = [winnow.runs_of(x.as_py() or b"", LENGTH, GRAM) for x in batch.cast(pa.binary())]
        cols = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(4)]
        ends = np.concatenate(([0], np.cumsum([len(g[0]) for g in got]))).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], ["first", "last", "anchor", "context"])
        yield pa.ListArray.from_arrays(pa.array(ends), rows)


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def cut_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes of each range. The first column, the id, is not read: it keeps the columns of this shuffle of the texts those of the last one."""
    for _, texts, ranges in batches:
        raw = [x.as_py() or b"" for x in texts.cast(pa.binary())]
        yield pa.array([[t[r["start"] : r["end"]] for r in x.as_py() or []] for t, x in zip(raw, ranges, strict=True)], pa.list_(pa.binary()))


@F.arrow_udf(T.ArrayType(T.StructType().add("start", "integer").add("h1", "long").add("h2", "long")))
def window_hashes_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Two hashes of every window inside each range."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    for texts, ranges in batches:
        rows = []
        for text, x in zip(texts.cast(pa.binary()), ranges, strict=True):
            raw, out = text.as_py() or b"", []
            for r in x.as_py() or []:
                h1, h2 = winnow.window_hashes(raw[r["start"] : r["end"]], LENGTH)
                out += [{"start": r["start"] + i, "h1": a, "h2": b} for i, (a, b) in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))]
            rows.append(out)
        yield pa.array(rows, kind)


@F.arrow_udf(T.StructType().add("spans", _RANGE).add("kept", "binary"))
def remove_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Union of the ranges as maximal spans, and the bytes outside of them."""
    for texts, settled, found in batches:
        spans, kept = [], []
        for text, a, b in zip(texts.cast(pa.binary()), settled, found, strict=True):
            raw = text.as_py() or b""
            gone = merged([(r["start"], r["end"]) for r in (a.as_py() or []) + (b.as_py() or [])])
            cuts = [0, *[x for m in gone for x in m], len(raw)]
            spans.append([tuple(m) for m in gone])
            kept.append(b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)))
        yield pa.StructArray.from_arrays([_ranges(spans), pa.array(kept, pa.binary())], ["spans", "kept"])


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Union of ranges as maximal ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One suffix array per group of anchors; rows come sorted by anchor."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        ranges: list[list[tuple[int, int]]] = [[] for _ in rows]
        for size, places in maximal_repeats([r["bytes"] for r in rows], LENGTH):
            for c, start in places:
                ranges[c].append((start, start + size))
        found = [(r, s, e) for r, x in zip(rows, ranges, strict=True) for s, e in merged(x)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r["kid"] for r, _, _ in found], pa.int64()), pa.array([r["th"] for r, _, _ in found], pa.int64()),
             pa.array([r["start"] + s for r, s, _ in found], pa.int32()), pa.array([r["start"] + e for r, _, e in found], pa.int32())],
            ["kid", "th", "start", "end"],
        )

    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if size >= BATCH_BYTES and row["anchor"] != rows[-1]["anchor"]:
                yield solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row["bytes"])
    if rows:
        yield solve(rows)


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed texts (``kid, th, id, text``), the settled ranges per text (``kid, th, settled``) and the ranges that the suffix
    arrays found (``kid, th, found``)."""
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), th.alias("th")).select(F.xxhash64("id", "th").alias("kid"), "th", "id", "text")
    runs = keyed.select("kid", "th", F.explode(runs_udf("text")).alias("r")).select("kid", "th", "r.*")
    # the key of a row follows from its columns, so no shuffle has to carry it
    row_key = F.xxhash64("kid", "th", "first")
    counted = runs.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(row_key).alias("chosen"))
    several = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    known = counted.join(several, "anchor", "left").filter("n > 1 OR c IS NOT NULL")
    joined = runs.join(known, ["anchor", "context"])
    window = F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"), "anchor", (F.col("c") > hot).alias("hot"))
    per_text = checkpointed(joined.groupBy("kid", "th").agg(
        F.collect_list(F.when(F.col("n") > 1, F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))).alias("settled"),
        F.collect_list(F.when(F.col("c").isNotNull() & (row_key == F.col("chosen")), window)).alias("open"),
    ))
    plain = lambda hot: F.transform(F.filter("open", lambda x: x["hot"] == hot), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    lists = per_text.select("kid", "th", F.filter("open", lambda x: ~x["hot"])["anchor"].alias("anchors"), plain(False).alias("cold_ranges"), plain(True).alias("hot_ranges"))
    cold = keyed.join(lists.filter(F.size("cold_ranges") > 0), ["kid", "th"])
    parts = cold.select("kid", "th", F.arrays_zip("anchors", F.col("cold_ranges")["start"].alias("start"), cut_udf("id", "text", "cold_ranges").alias("bytes")).alias("p"))
    contexts = parts.select("kid", "th", F.explode("p").alias("p")).select("kid", "th", F.col("p.anchors").alias("anchor"), "p.start", "p.bytes")
    found = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats, "kid long, th long, start int, end int")
    if not lists.filter(F.size("hot_ranges") > 0).isEmpty():
        crowd = keyed.join(lists.filter(F.size("hot_ranges") > 0), ["kid", "th"])
        windows = crowd.select("kid", "th", F.explode(window_hashes_udf("text", "hot_ranges")).alias("w")).select("kid", "th", "w.*")
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
        found = found.unionByName(windows.join(twice, ["h1", "h2"]).select("kid", "th", "start", (F.col("start") + LENGTH).alias("end")))
    ranges = found.groupBy("kid", "th").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return keyed, per_text.select("kid", "th", "settled"), ranges


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans`` (bytes, end exclusive) and ``kept`` (binary) for every row."""
    keyed, settled, found = find_repeats(docs, doc_id, text, hot)
    all_of = keyed.join(settled, ["kid", "th"], "left").join(found, ["kid", "th"], "left")
    done = all_of.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), remove_udf("text", "settled", "found").alias("out"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "out.spans", "out.kept")


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    done = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeat"),
    )
