"""One document of each class of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

Candidates come from the SimHash chains of :mod:`.simhash` and, for what these cannot see, from segments of the shingle sets. Two
documents at a similarity of 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9. A limit of 14 bits would be needed, for
which the equal part of a chain is four bits long and joins nearly everything. So SimHash finds the close copies (two bits), and
documents that agree in a whole segment of about seven shingles are candidates as well: each segment survives with probability 0.8 per
shingle, so a text of 100 words loses all of its segments once in some thousand pairs. Sets in segments that very many sets share
are compared by prefixes of their rarest shingles, which leave out no similar pair among them. Every class is then verified exactly on the
shingles (:func:`.jaccard.verified_links`), so nothing below the limit is tied.

Defined cases: a text with fewer than five words has one shingle, the whole sequence; texts without words are one class; null ids come
last; a repeated row stays once; an empty table gives no rows; further columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import fits
from . import jaccard, simhash
from .common import checkpointed, fresh, split_join

SHINGLE = 5
MIN_PERCENT = 80
#: Shingles of a segment, and segments below which a set has as many as its possible differences ask for.
SEGMENT_TOKENS = 7
FEW_SEGMENTS = 24
MAX_BROADCAST_ROWS = 200_000


class Segments(jaccard.Levels):
    """Levels whose segments have about ``SEGMENT_TOKENS`` tokens."""

    def segments(self, level: int) -> int:
        return min(super().segments(level), max(FEW_SEGMENTS, self.starts[level] // SEGMENT_TOKENS))


def prefix_ties(tokens: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """``a, b``: sets tied to the smallest one of a common token of their prefixes; ``tokens`` has ``sid, own, key``, with the set size in ``own``.

    In one order of all tokens, the rare ones first, two sets with a similarity of at least ``percent`` hundredths have a token in common
    among the first ``own - ceil(percent * own / 100) + 1`` of each. So no such pair is left out, and a passage that many sets share
    ties only those that have little else.
    """
    frequency = checkpointed(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).withColumn("sets", F.col("n"))
    order = Window.partitionBy("sid").orderBy("sets", "key")
    ranked = split_join(tokens, frequency, ["key"]).withColumn("rank", F.row_number().over(order))
    entries = checkpointed(ranked.filter(F.col("rank") <= F.floor((100 - percent) * F.col("own") / 100) + 1).select("sid", "key"))
    return jaccard.ties_of(entries, jaccard.common_keys(entries))


def tokens_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``sid, own, key``: a row for every token of the sets in ``members`` (``sid, th, least_id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = jaccard._Hashes()
        for batch in batches:
            for x, sid in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                tokens = jaccard.token_set(x.as_py() or b"", known, size).view(np.int64)
                n = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sid, np.int64)), pa.array(np.full(n, n, np.int64)), pa.array(tokens)], ["sid", "own", "key"])

    return jaccard.texts_of(docs, members, doc_id, text).select("text", "sid").mapInArrow(run, "sid long, own long, key long")


def segment_ties(
    docs: DataFrame, prints: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = MIN_PERCENT, hot_key: int = jaccard.HOT_KEY
) -> DataFrame:
    """``a, b``: ties that join every two similar sets with a common segment.

    A segment of up to ``hot_key`` sets ties them to the smallest one. Segments of more sets are often filled by one passage that
    documents share without being alike; the sets that have such a segment are tied by the prefixes of their tokens instead.
    """
    filled = prints.filter("n > 0")
    entries = filled.select("sid", F.explode("keys").alias("key"))
    keys = jaccard.common_keys(entries)
    cold = jaccard.ties_of(entries, keys.filter(F.col("n") <= hot_key))
    held = checkpointed(split_join(entries, keys.filter(F.col("n") > hot_key).select("key", "n"), ["key"]).select("sid").distinct())
    if held.isEmpty():
        return cold
    one = filled.groupBy("sid").agg(F.min(F.struct("th", "doc_id")).alias("d"))
    members = checkpointed(held.join(one, "sid").select("sid", F.col("d.th").alias("th"), F.col("d.doc_id").alias("least_id")))
    tokens = checkpointed(tokens_of(docs, members, doc_id, text, size).distinct())
    return cold.unionByName(prefix_ties(tokens, percent))


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """``th, root`` for every different text (by its hash ``th``): near-duplicates share a root."""
    prints = checkpointed(jaccard.set_prints(docs, doc_id, text, Segments(percent), size, filled=True))
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    bits = checkpointed(docs.select(th.alias("th"), simhash.fingerprint_udf(F.col(text)).alias("fp")).distinct())
    texts = checkpointed(prints.select("th", "sid").distinct().join(bits, "th"))
    close = texts.join(simhash.components(simhash.links_of(bits.select("fp").distinct())), "fp", "left").select("sid", F.coalesce("root", "fp").alias("bits_root"))
    least = close.groupBy("bits_root").agg(F.min("sid").alias("a"), F.max("sid").alias("most"), F.count(F.lit(1)).alias("n")).filter("a < most").select("bits_root", "a", "n")
    by_bits = split_join(close, least, ["bits_root"]).filter("a < sid").select("a", F.col("sid").alias("b")).distinct()
    by_segments = segment_ties(docs, prints, doc_id, text, size, percent)
    families = simhash.components(by_bits.unionByName(by_segments).distinct()).select(F.col("fp").alias("sid"), "root")
    links = jaccard.verified_links(docs, prints.filter("n > 0"), families, doc_id, text, size, percent, jaccard.BLOCK_SETS, jaccard.BLOCK_TOKENS)
    roots = simhash.components(links).withColumnRenamed("fp", "sid")
    return texts.select("th", "sid").distinct().join(roots, "sid", "left").select("th", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash, then the smallest hash of the row; a repeated row stays once."""
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    cells = [F.col(f"`{c}`") for c in docs.columns]
    # the hash skips nulls, so where they are counts as well
    row = F.xxhash64(*cells, *[c.isNull() for c in cells])
    rows = checkpointed(docs.select(F.col(doc_id).alias("id"), th.alias("th"), row.alias("row")).groupBy("id", "th", "row").agg(F.count(F.lit(1)).alias("times")))
    classes = classes_of(docs, doc_id, text, size, percent).join(rows.groupBy("th").agg(F.count(F.lit(1)).alias("n")), "th")
    rooted = checkpointed(split_join(rows, classes, ["th"]))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "row")).alias("first"))
    kept = first.select(F.col("first.th").alias("th"), F.col("first.row").alias("row"))
    gone = checkpointed(rooted.select("th", "row").distinct().join(kept, ["th", "row"], "left_anti"))
    th_name, row_name = fresh(docs, "text_hash"), fresh(docs, "row_hash")
    gone = gone.select(F.col("th").alias(th_name), F.col("row").alias(row_name))
    if fits(gone, MAX_BROADCAST_ROWS):
        gone = F.broadcast(gone)
    chosen = docs.withColumns({th_name: th, row_name: row}).join(gone, [th_name, row_name], "left_anti").drop(th_name, row_name)
    return chosen if rows.filter("times > 1").isEmpty() else chosen.dropDuplicates()
