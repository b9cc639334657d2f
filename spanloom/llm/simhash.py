"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits come from 3-word shingles. Two fingerprints within ``MAX_BITS`` differing bits are linked. The bits form a
ring of ``SEGMENTS`` segments; each segment has a budget of ``MAX_BITS / SEGMENTS`` differences. By the pigeonring principle any
linked pair has a segment from which every chain of l consecutive segments differs in at most ``l * MAX_BITS / SEGMENTS`` bits.
With 8 segments and 2 bits the first three segments of the chain must be equal, the first seven may differ in one bit, and all
eight in two. Equal triples of segments (24 bits, eight starts) are the join key; the longer chains prune what is left before the
full Hamming check.

Only different fingerprints are joined; documents with equal ones are a class from the start. Where more than ``HOT`` different
fingerprints share a key, pairs are not compared: each of them lists its 65 neighbours within one bit, and those with a common
neighbour are linked to the smallest one. Fingerprints within two bits always have a common neighbour, so no link is lost, and the
work stays linear.

Classes grow by minimum labels over the links, with the label of the label taken in each round.

Defined cases: texts with fewer than 3 words have one shingle, the whole sequence; null, empty and blank texts have fingerprint zero
and are linked like any other; repeated rows share a fingerprint; a null id is never the smallest unless the class has no other;
an empty table gives no rows; only id and text are read, so further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 8
HOT = 1000
_CHUNK = 1 << 16


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(flat)]))
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        pieces = [flat[a:b] for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


@F.arrow_udf(T.LongType())
def fingerprint_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(x.as_py() or b"") for x in batch.cast(pa.binary())], pa.int64())


def _segment(fp: Column, i: int, width: int = 64 // SEGMENTS) -> Column:
    return F.shiftrightunsigned(fp, (i % SEGMENTS) * width).bitwiseAND(F.lit((1 << width) - 1))


def _chain(fp: Column, start: int, length: int) -> Column:
    """The bits of ``length`` consecutive segments of the ring as one number."""
    width = 64 // SEGMENTS
    out = _segment(fp, start)
    for j in range(1, length):
        out = out.bitwiseOR(F.shiftleft(_segment(fp, start + j), j * width))
    return out


def links_of(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` (a < b) between different fingerprints of ``prints`` (column ``fp``, no repeats).

    Within ordinary keys every pair within the limit is returned; fingerprints of a hot key are linked to the smallest one that
    shares a neighbour with them.
    """
    free = (SEGMENTS - 1) // MAX_BITS  # segments of a chain that leave no difference
    entries = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("start"), _chain(F.col("fp"), s, free).alias("key")) for s in range(SEGMENTS)
    ])).alias("k")).select("fp", "k.start", "k.key")
    sizes = entries.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = entries.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= hot)).select("start", "key"), ["start", "key"])
    left, right = shared.select("start", "key", F.col("fp").alias("a")), shared.select("start", "key", F.col("fp").alias("b"))
    width, diff = 64 // SEGMENTS, F.expr("a ^ b")
    # the ring turned so that the chain of this key starts at bit 0; then all but the last segment
    turned = F.expr(f"CASE WHEN start = 0 THEN a ^ b ELSE shiftrightunsigned(a ^ b, start * {width}) | shiftleft(a ^ b, 64 - start * {width}) END")
    chain = F.bit_count(turned.bitwiseAND(F.lit((1 << (64 - width)) - 1))) <= (SEGMENTS - 1) * MAX_BITS // SEGMENTS
    pairs = left.join(right, ["start", "key"]).filter((F.col("a") < F.col("b")) & chain & (F.bit_count(diff) <= MAX_BITS)).select("a", "b")
    crowded = entries.join(sizes.filter(F.col("n") > hot).select("start", "key"), ["start", "key"]).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    smallest = near.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("near", "a")
    stars = near.join(smallest, "near").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """``fp, root`` for every fingerprint in a link: the smallest fingerprint of its class.

    In each round every group of equal labels looks for the least label around any of its members and takes the label which that one
    takes, so long paths and chains of near copies need few rounds. Every node is its own neighbour too, which gives its own label in
    the same join. Tables that small would be broadcast one after another, each through the driver, so the joins are merges.
    """
    links = checkpointed(links.select("a", "b"))
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(ends.union(ends.select("a", F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root"))
    while True:
        around = written(edges.join(labels.select(F.col("fp").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("fp")).agg(
            F.min("root").alias("near"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("old")
        ))
        if around.filter("near <> old").isEmpty():
            return around.select("fp", F.col("old").alias("root"))
        hooks = around.groupBy("old").agg(F.min("near").alias("near"))
        jumps = hooks.join(hooks.select(F.col("old").alias("near"), F.col("near").alias("root")).hint("merge"), "near").select("old", "root")
        labels = written(around.select("fp", "old").join(jumps.hint("merge"), "old").select("fp", "root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the class of a document is the smallest document id that links lead to."""
    prints = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(F.col(text)).alias("fp")))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links_of(classes.select("fp")))
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

