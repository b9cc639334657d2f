"""Quality rules with cross-document line frequency, in DataFrame operations only.

Every document gets counts of its words, symbols, repeated lines and repeated word windows. Across documents, lines are normalised
(lower case, white space collapsed), hashed, counted once per document within each host, and removed where they occur in more
documents of the host than the limit. A document that loses most of its words that way is depleted and rejected.

A line is over the limit when it is in more than ``MIN_DOCS`` documents of its host, however large the host is. The lines of all
documents meet the lines over the limit by host and hash; what is found goes back to the texts as one short array each.

Defined cases: null text has no words (``base_failed``, not kept); a null host is a host of its own; empty lines are neither
counted nor removed; repeated rows count as documents; an empty table gives no rows; only the named columns are read, so further
columns and clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fits
from .common import ASCII_WS, bind, checkpointed, split_join, table

MIN_DOCS = 10
MIN_WORDS = 20
WINDOW = 8
#: (host, line) pairs (16 bytes each) and texts with their lines over the limit that are broadcast; beyond it they meet in a shuffle.
MAX_BROADCAST_LINES = 200_000
MAX_BROADCAST_TEXTS = 100_000
#: Copies of a text's lines, so that copies of a text spread over tasks.
SALTS = 16

_WS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{ASCII_WS}]+"))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_pairs(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            # get() with index -1 is null, which a filter takes for false
            return bind(F.sort_array(twice["i"]), lambda at: F.aggregate(
                F.transform(at, lambda a, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1), a + n) - a)), F.lit(0), lambda s, x: s + x
            ))

        return bind(pairs, of_pairs)

    def of_words(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - (n - 1)), lambda i: F.xxhash64(F.slice(hashed, i, n)))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > n, bind(hashed, of_words)).otherwise(F.lit(0)).cast("long")


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` next to the ``keep`` columns and the text."""
    body = F.coalesce(text, F.lit(""))
    split = docs.select(*keep, F.col(text), words_of(F.col(text)).alias("words"), F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_WS)) != "").alias("filled"))
    return split.select(
        *keep, text, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def normal_lines(text: Column) -> Column:
    """Normalised lines, in the order of the lines of the text."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def host_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``host, th, line_hash``: every different line of a document once; ``host`` is not null here, ``th`` is the hash of the text."""
    per_doc = F.array_distinct(F.transform(F.filter(normal_lines(F.col(text)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return docs.select(_host_key(host).alias("host"), F.xxhash64(text).alias("th"), F.explode(per_doc).alias("line_hash"))


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``host, line_hash, n``: those of :func:`host_lines` that are in more than ``min_docs`` documents of their host."""
    return lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)


def filter_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), host: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``keep`` columns, base counts, ``clean_text``, ``n_lines_removed``, ``n_words_left``, ``base_failed``, ``kept``."""
    lines = checkpointed(host_lines(docs, host, text))
    frequent = checkpointed(frequent_lines(lines, min_docs))
    found = lines.join(F.broadcast(frequent.drop("n")), ["host", "line_hash"]) if fits(frequent, MAX_BROADCAST_LINES) else split_join(lines, frequent, ["host", "line_hash"])
    of_text = checkpointed(found.groupBy(F.col("host").alias("line_host"), F.col("th").alias("line_text")).agg(F.collect_set("line_hash").alias("hot_lines")))
    rows = docs.select(*keep, text, _host_key(host).alias("line_host"), F.xxhash64(text).alias("line_text"))
    if fits(of_text, MAX_BROADCAST_TEXTS):
        joined = rows.join(F.broadcast(of_text), ["line_host", "line_text"], "left")
    else:
        salted = of_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int")).join(salted, ["line_host", "line_text", "salt"], "left")
    counted = base_counts(joined, (*keep, "hot_lines"), text)
    lines = F.arrays_zip(F.split(F.coalesce(text, F.lit("")), "\n").alias("raw"), normal_lines(F.col(text)).alias("norm"))
    marked = F.transform(lines, lambda x: F.struct(x["raw"].alias("raw"), F.array_contains("hot_lines", F.xxhash64(x["norm"])).alias("hot")))
    sorted_out = counted.withColumn("lines", F.when(F.col("hot_lines").isNotNull(), marked))
    gone = F.filter("lines", lambda x: x["hot"] & (F.btrim(x["raw"], F.lit(_WS)) != ""))
    lost = F.coalesce(F.aggregate(gone, F.lit(0), lambda s, x: s + F.size(words_of(x["raw"]))), F.lit(0)).cast("long")
    cleaned = sorted_out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("lines").isNull(), F.col(text)).otherwise(F.array_join(F.filter("lines", lambda x: ~x["hot"])["raw"], "\n")).alias("clean_text"),
        F.coalesce(F.size(gone), F.lit(0)).alias("n_lines_removed"), (F.col("n_words") - lost).alias("n_words_left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("n_words_left") < F.col("n_words")) & ((2 * F.col("n_words_left") < F.col("n_words")) | (F.col("n_words_left") < MIN_WORDS))
    return cleaned.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, their source as the host."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return filter_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept"
    )


_WORDS = "regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+')"
_NORM = "trim(regexp_replace(lower({}), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
filled AS (SELECT doc_id, source, line, {_NORM.format("line")} AS norm, len({_WORDS.format("line")}) AS n FROM lines WHERE len({_WORDS.format("line")}) > 0),
dup_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM filled GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
hot AS (SELECT source, norm FROM filled GROUP BY source, norm HAVING count(DISTINCT doc_id) > {MIN_DOCS}),
lost AS (SELECT doc_id, sum(n) AS n FROM filled f SEMI JOIN hot h ON f.norm = h.norm AND f.source IS NOT DISTINCT FROM h.source GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(words) - coalesce(lost.n, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN dup_lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (n_words_left < n_words AND (2 * n_words_left < n_words OR n_words_left < {MIN_WORDS})) AS kept
FROM counts
"""
