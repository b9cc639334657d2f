"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a mean repetition rate ``target share * budget / size of the source``. A document's count is the inverse of the
Poisson distribution at a number in [0, 1) hashed from seed and document id, so a rerun or a recomputed task gives the same counts.
Documents are exploded by their counts and put in a global random order: a hashed key of each copy sets its partition and its
place in it.

A mean above ``PIECE`` is split into equal parts with numbers of their own, as sums of Poisson variables are Poisson; this keeps
``exp(-mean)`` away from zero.

Defined cases: a null source is a source of its own; null and empty texts have size 0 but are replicated like any other document
of their source; a source of total size 0 or without a weight has rate 0; repeated rows with the same id get the same count;
negative and null weights count as 0; an empty table gives no rows; further columns are kept, and names that clash with the added
ones (``copy``, ``mix_key``) get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fits
from .common import fresh, table, unit_hash

PIECE = 16.0
#: Sources up to this number are broadcast; beyond it the join is left to Spark, which splits hot sources.
MAX_BROADCAST_SOURCES = 20_000


def poisson_count(rate: Column, seed: str, doc_id: Column) -> Column:
    """Inverse Poisson distribution at hashed numbers; 0 for a rate of 0."""
    parts = F.ceil(rate / PIECE).cast("int")
    mean = rate / parts

    def one(u: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
        # 80 steps leave less than 1e-25 above them for means up to PIECE
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(80)), start,
            lambda s, k: F.when(u < s["c"], s).otherwise(
                F.struct(k.alias("k"), (s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"))
            ),
        )
        return end["k"]

    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: one(unit_hash(F.lit(seed), doc_id, j)))
    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget_chars: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """``source, chars, rate``: one row per source, by partial sums over all documents.

    ``weights``: (source, weight); without it each source weighs the square root of its size. ``budget_chars``: expected size of the
    mixture; by default the size of the corpus.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("chars"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.sqrt("chars"))
    else:
        given = weights.select(F.col("source").alias("of"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")).groupBy("of").agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["of"]), "left").drop("of").fillna(0.0, ["weight"])
    # sources without text cannot be sized; they take no share
    usable = weighted.withColumn("weight", F.when(F.col("chars") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    total = usable.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars")).first()
    all_weight, all_chars = float(total["all_weight"] or 0), float(total["all_chars"] or 0)
    budget = float(all_chars if budget_chars is None else budget_chars)
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(all_weight or 1.0) * F.lit(budget) / F.col("chars")).otherwise(F.lit(0.0))
    return usable.select("source", "chars", rate.alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, budget_chars: float | None = None, seed: str = "mix-1", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``copy`` (1..count) and ``mix_key``, in a global random order."""
    rates = source_rates(docs, weights, budget_chars, source, text)
    of, rate, copy, key = fresh(docs, "mix_source"), fresh(docs, "mix_rate"), fresh(docs, "copy"), fresh(docs, "mix_key")
    side = rates.select(F.col("source").alias(of), F.col("rate").alias(rate))
    if fits(side, MAX_BROADCAST_SOURCES):
        side = F.broadcast(side)
    count = poisson_count(F.col(rate), seed, F.col(doc_id))
    counted = docs.join(side, docs[source].eqNullSafe(side[of])).withColumn(copy, count).filter(F.col(copy) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), copy))).drop(of, rate)
    keyed = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), copy).cast("binary")))
    return keyed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


def op4_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture of all documents, each source weighing the square root of its size, as large as the corpus."""
    return mix(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


_U = "CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || {j}), 1, 13) AS BIGINT) / 4503599627370496.0"
OP4_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
total AS (SELECT sum(sqrt(chars)) AS w, sum(chars) AS c FROM sizes),
rates AS (SELECT source, CASE WHEN chars > 0 THEN sqrt(chars) / w * c / chars ELSE 0 END AS rate FROM sizes, total),
parts AS (SELECT source, rate, CAST(ceil(rate / {PIECE}) AS INTEGER) AS n, rate / ceil(rate / {PIECE}) AS mean FROM rates WHERE rate > 0),
steps(source, k, p, c) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL SELECT s.source, k + 1, s.p * mean / (k + 1), s.c + s.p * mean / (k + 1) FROM steps s JOIN parts USING (source) WHERE k < 80),
draws AS (SELECT d.doc_id, d.source, unnest(range(1, n + 1)) AS j FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
counts AS (
  SELECT doc_id, j, (SELECT count(*) FROM steps s WHERE s.source = x.source AND s.c <= x.u) AS k
  FROM (SELECT doc_id, source, j, {_U.format(j="j")} AS u FROM draws) x),
per_doc AS (SELECT doc_id, CAST(sum(k) AS INTEGER) AS n FROM counts GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.copy, md5('mix-1:order:' || CAST(d.doc_id AS VARCHAR) || ':' || t.copy) AS mix_key
FROM documents d JOIN (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM per_doc) t USING (doc_id)
"""
