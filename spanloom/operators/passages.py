"""Where whole passages stand in texts, for passage tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sizes import cut_lineage
from ..functions.terms import found_terms
from ..functions.text import lit_let
from .candidates import find_quote

#: Words of an anchor.
ANCHOR_WORDS = 4
#: Bytes up to which the smaller side of a join is broadcast.
MAX_BROADCAST_BYTES = 32_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, T.WS + "+"), lambda w: w != "")


def _inner(text: Column) -> Column:
    """The words of a passage but the first and the last, which may be parts of words in a text."""
    return lit_let(_words(text), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))


def _grams(words: Column) -> Column:
    """Hashes of the distinct word n-grams; white space between the words does not count."""
    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - ANCHOR_WORDS + 1)
        return F.when(F.size(w) >= ANCHOR_WORDS, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(ANCHOR_WORDS))))))

    return lit_let(words, hashed)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast where the summed size is proven small; otherwise the join is left to Spark."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= MAX_BROADCAST_BYTES else df


def place_passages(rows: DataFrame, passages: DataFrame, *, key: str = "doc_id", text: str = "text", loose: bool = False) -> DataFrame:
    """(``key``, item_id, char_start, char_end): the first place of each passage in each text that holds it.

    ``passages`` has item_id and text. A text holds a passage as written; with ``loose``, also with any white space between its
    words where it is not there as written. The passage may begin and end inside words. Passages without a word, null passages and
    null texts have no place. Passages with one text all have its places; repeated rows have repeated places.

    One pass over the texts meets their word n-grams with those inside the passages. Each passage is then looked for only where the
    n-gram that the fewest texts hold, its anchor, occurs; a passage with an n-gram that no text holds is settled without a look. Passages
    too short for an anchor are looked for where their longest word occurs. No passage reaches the driver or the plan but for the
    longest words of short ones, in blocks.
    """
    given = passages.select("item_id", F.col("text").alias("__passage")).filter(F.size(_words(F.col("text"))) > 0)
    said = given.select("__passage").distinct().withColumn("__inner", _inner(F.col("__passage")))
    texts = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    own = cut_lineage(said.select("__passage", F.explode(_grams(F.col("__inner"))).alias("gram")))
    wanted = own.select("gram").distinct()
    met = texts.select("__key", F.explode(_grams(_words(F.col("__text")))).alias("gram")).join(_small(wanted, F.lit(32)), "gram", "left_semi")
    met = cut_lineage(met)
    spread = own.join(met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    anchors = spread.groupBy("__passage").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    ).filter("n > 0").select("gram", "__passage")

    longest = F.array_max(F.transform(_words(F.col("__passage")), lambda w: F.struct(F.length(w).alias("n"), w.alias("term"))))
    short = said.filter(F.size("__inner") < ANCHOR_WORDS).select(longest["term"].alias("term"), "__passage")
    seen = found_terms(texts, "__text", ["__key"], short.select("term").distinct()).join(short, "term")

    likely = cut_lineage(met.join(anchors, "gram").select("__key", "__passage").unionByName(seen.select("__key", "__passage")).distinct())
    likely = _small(likely, F.octet_length("__passage") + 64).withColumnRenamed("__key", "__of")
    looked = texts.join(likely, F.col("__key").eqNullSafe(F.col("__of")))
    placed = looked.select("__key", "__passage", F.inline(F.array_compact(F.array(_place(F.col("__text"), F.col("__passage"), loose)))))
    return placed.join(given, "__passage").select(F.col("__key").alias(key), "item_id", "char_start", "char_end")


def _place(text: Column, passage: Column, loose: bool) -> Column:
    if loose:
        return find_quote(text, passage, F.lit(0))
    return lit_let(
        F.position(passage, text) - 1,
        lambda at: F.when(at >= 0, F.struct(at.alias("char_start"), (at + F.length(passage)).alias("char_end"))),
    )
