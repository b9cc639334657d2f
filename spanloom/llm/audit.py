"""Interaction of document filters: what each order of five filters keeps, removes and wastes.

Filter E asks for an identical text with a smaller id. Texts whose 64-bit hash occurs with two ids or more are the only ones that can
fail it. Their smallest id per exact text is a witness; documents meet the witnesses in a left-semi join on hash, exact text and
smaller id. A hash that holds a thousandth of all rows is spread over salts, so that no group of copies lands in one task.

A document is one row of failure bits: those of A to D from one pass over the text, that of E united with them by id. Documents are
then counted per part and combination of bits (at most 32 rows each). Everything about the 120 orders follows from these counts: a
step depends only on its filter and on the set of filters before it (80 cases), which are summed once and joined with the orders.

Defined cases: null text is empty; a null source is the empty part; a null id is never smaller than another one and has none before
it; repeated rows of one id are identical to each other but not to a smaller id, and all are counted; labels of a repeated id count if
any of its rows has them; an empty table gives no rows; texts of any length are read whole; only the named columns are read, so further
columns and clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizes import fits
from .common import checkpointed, hot_keys, table

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
#: Salts of a hash that holds a thousandth of all rows.
SALTS = 64
#: Hashes (8 bytes each) up to this number are broadcast; beyond it they are joined in a shuffle.
MAX_BROADCAST_HASHES = 1_000_000

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"


def failures(raw: bytes) -> int:
    """Bits 1, 2, 4, 8 for the filters A, B, C, D."""
    words = raw.split()
    chars = len(raw.translate(None, _CONTINUED))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT * len(words))
        + 4 * (100 * capitals > MAX_CAPITALS * chars) + 8 * (len(raw.translate(None, _SIGNS)) < len(raw))
    )


@F.arrow_udf(T.IntegerType())
def failures_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([failures(x.as_py() or b"") for x in batch.cast(pa.binary())], pa.int32())


def earlier_copies(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """``doc_id, part, hash, size`` of the rows whose text is identical to that of a smaller id. ``narrow`` has these columns for all rows."""
    shared = checkpointed(
        narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most").select("hash", "n")
    )
    hot = checkpointed(hot_keys(shared, least=SALTS).select("hash", F.lit(SALTS).alias("salts")))
    salted = shared.join(F.broadcast(hot), "hash", "left").select("hash", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    if fits(salted, MAX_BROADCAST_HASHES):
        salted = F.broadcast(salted)
    rows = docs.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    copies = rows.drop("salts").join(salted, ["hash", "salt"], "left_semi")
    # the copies of a text are reduced inside each task; one row per text and salt meets the rest
    witnesses = copies.groupBy("hash", "salt", "text").agg(F.min("doc_id").alias("first")).groupBy("hash", "text").agg(F.min("first").alias("first"))
    spread = witnesses.join(F.broadcast(hot), "hash", "left").select(
        "hash", F.col("text").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    found = copies.alias("c").join(
        spread.alias("w"),
        (F.col("c.hash") == F.col("w.hash")) & (F.col("c.salt") == F.col("w.salt")) & (F.col("c.text") == F.col("w.same")) & (F.col("w.first") < F.col("c.doc_id")),
        "left_semi",
    )
    return found.select("doc_id", "part", "hash", "size")


def failure_bits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, bits, n``: the failure bits (1 to 16 for A to E) of ``n`` documents of one id."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.xxhash64(body).alias("hash"), F.octet_length(body).alias("size"), body.alias("text")
    )
    narrow = checkpointed(keyed.select("doc_id", "part", "hash", "size", failures_udf(F.col("text")).alias("bits")))
    copies = earlier_copies(keyed, narrow).select("doc_id", "part", "hash", "size", F.lit(16).alias("bits"), F.lit(0).alias("one"))
    united = narrow.withColumn("one", F.lit(1)).unionByName(copies)
    return united.groupBy("doc_id", "part", "hash", "size").agg(F.bit_or("bits").alias("bits"), F.sum("one").alias("n")).select("doc_id", "part", "bits", "n")


def combinations(bits: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: documents per part and combination of failures, and how many of them are labelled so."""
    bits = checkpointed(bits)
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    none = F.lit(0).cast("long")
    counted = bits.select("part", "bits", "n", none.alias("good"), none.alias("toxic"))
    labelled = bits.join(marks, "doc_id").select("part", "bits", none.alias("n"), (F.col("good").cast("long") * F.col("n")).alias("good"), (F.col("toxic").cast("long") * F.col("n")).alias("toxic"))
    return counted.unionByName(labelled).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter_order, step, bit, before``: every order of the filters, step by step; ``before`` has the bits of the earlier steps."""
    rows = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the counts of :func:`combinations`."""
    k = len(filters)
    cases = [(1 << f, b) for f in range(k) for b in range(1 << k) if not b >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in cases]))
    case = counts.select("*", each.alias("c")).select("part", "bits", "n", "good", "toxic", "c.bit", "c.before")
    fails, gone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    n_orders = 1
    for i in range(2, k + 1):
        n_orders *= i
    # a document that fails m filters is removed by each of them in one m-th of all orders
    summed = case.groupBy("part", "bit", "before").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.expr(f"n * {n_orders} div bit_count(bits)")).otherwise(0)).alias("shapley"),
    )
    return summed.join(F.broadcast(orders(counts.sparkSession, filters)), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, per source."""
    return audit_orders(combinations(failure_bits(table(spark, sf, "documents")), table(spark, sf, "labels")))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
failed AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
  FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, bits),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, (1 << (strpos('ABCDE', filter_order[step]) - 1))::INTEGER AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))), 0)::INTEGER AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
run AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN bits & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM run
"""
