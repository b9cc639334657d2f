"""Offset arithmetic: regex matches with character offsets, and joins on intervals.

Offsets are code points, 0-based, end-exclusive. Everything that works inside one text
stays inside its row, so finding spans never shuffles the text.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lit_let

# A Unicode noncharacter marks match boundaries; a text that holds one is matched on a
# copy of equal length, so offsets stay exact.
MARK = "\uffff"
STAND_IN = "\ufffe"

SPAN_TYPE = "array<struct<char_start:int,char_end:int,text:string>>"
#: Most elements of a slice of a running fold.
SCAN_CHUNK = 256
#: Lengths whose sums are written out.
SUM_GROUP = 8
DEFAULT_BUCKET = 16384


def scan(xs: Column, zero: Column, step, emit, emit_type: str) -> Column:
    """Running fold over an array: the emitted value of every intermediate state.

    Appending to a growing array copies it at each step. The fold therefore runs over slices, as many as a slice has elements
    (and of at most ``SCAN_CHUNK``), and concatenates the slices once.
    """
    empty = F.array().cast(f"array<{emit_type}>")

    def one(acc: Column, x: Column) -> Column:
        return lit_let(
            step(acc["st"], x),
            lambda s: F.struct(
                s.alias("st"), F.concat(acc["out"], F.array(emit(s).cast(emit_type))).alias("out")
            ),
        )

    def chunks(width: Column) -> Column:
        def chunk(acc: Column, c: Column) -> Column:
            part = F.aggregate(
                F.slice(xs, c * width + 1, width),
                F.struct(acc["st"].alias("st"), empty.alias("out")),
                one,
            )
            return lit_let(
                part,
                lambda p: F.struct(
                    p["st"].alias("st"), F.concat(acc["parts"], F.array(p["out"])).alias("parts")
                ),
            )

        n_chunks = F.greatest(F.ceil(F.size(xs) / width).cast("int"), F.lit(1))
        return F.aggregate(
            F.sequence(F.lit(0), n_chunks - 1),
            F.struct(zero.alias("st"), F.array().cast(f"array<array<{emit_type}>>").alias("parts")),
            chunk,
            lambda acc: F.flatten(acc["parts"]),
        )

    return lit_let(F.greatest(F.least(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(SCAN_CHUNK)), F.lit(1)), chunks)


def offsets_before(lengths: Column) -> Column:
    """Sum of all earlier lengths, for each position.

    Only the sums of groups of ``SUM_GROUP`` lengths are summed up one by one; within a group every sum is written out.
    """

    def within(xs: Column, k: Column, base: Column) -> Column:
        """Sums before each length of group ``k``; null behind the last one."""
        sums = [base]
        for j in range(SUM_GROUP - 1):
            sums.append(sums[-1] + F.get(xs, k * SUM_GROUP + j))
        return F.array(*sums)

    def total(xs: Column, k: Column) -> Column:
        parts = [F.coalesce(F.get(xs, k * SUM_GROUP + j), F.lit(0)) for j in range(SUM_GROUP)]
        return reduce(add, parts)

    def before(xs: Column) -> Column:
        groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / F.lit(SUM_GROUP)).cast("int"), F.lit(1)) - 1)
        bases = lit_let(F.transform(groups, lambda k: total(xs, k)), lambda sums: scan(
            sums,
            F.struct(F.lit(0).alias("at"), F.lit(0).alias("next")),
            lambda st, x: F.struct(st["next"].alias("at"), (st["next"] + x).alias("next")),
            lambda st: st["at"],
            "int",
        ))
        return F.slice(F.flatten(F.transform(bases, lambda base, k: within(xs, k, base))), 1, F.size(xs))

    return lit_let(lengths, before)


def pieces(text: Column, marked) -> Column:
    """Cut ``text`` where ``marked`` puts marks; alternates gap, match, gap, ... with offsets.

    ``marked`` maps the text column to the same text with ``MARK`` around each match.
    """
    safe = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(STAND_IN))).otherwise(text)

    def with_offsets(p: Column) -> Column:
        return lit_let(
            offsets_before(F.transform(p, lambda x: F.length(x))),
            lambda at: F.transform(
                p,
                lambda x, i: F.struct(
                    F.get(at, i).alias("char_start"),
                    (F.get(at, i) + F.length(x)).alias("char_end"),
                    x.alias("text"),
                    (i % 2 == 1).alias("is_match"),
                ),
            ),
        )

    def restored(p: Column) -> Column:
        return F.when(
            F.contains(text, F.lit(MARK)),
            F.transform(
                p,
                lambda s: s.withField(
                    "text", F.substring(text, s["char_start"] + 1, s["char_end"] - s["char_start"])
                ),
            ),
        ).otherwise(p)

    cut = lit_let(F.split(marked(safe), MARK, -1), with_offsets)
    return lit_let(cut, restored)


def mark_matches(pattern: Column | str):
    if isinstance(pattern, str):
        return lambda t: F.regexp_replace(t, f"({pattern})", f"{MARK}$1{MARK}")
    return lambda t: F.regexp_replace(
        t, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{MARK}$1{MARK}")
    )


def match_spans(text: Column, pattern: Column | str) -> Column:
    """All non-overlapping matches of a pattern as an array of (char_start, char_end, text)."""
    found = F.filter(pieces(text, mark_matches(pattern)), lambda s: s["is_match"])
    return F.transform(
        found,
        lambda s: F.struct(
            s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), s["text"].alias("text")
        ),
    )


def gap_spans(text: Column, marked) -> Column:
    """The stretches between matches, in order, empty ones included."""
    return F.filter(pieces(text, marked), lambda s: ~s["is_match"])


def overlap_chars(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _bucket(col: Column, width: int) -> Column:
    return F.floor(col / F.lit(width)).cast("int")


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    key: str = "doc_id",
    point: str,
    start: str,
    end: str,
    how: str = "inner",
    bucket: int = DEFAULT_BUCKET,
) -> DataFrame:
    """Join each point to the intervals [start, end) of the same key that hold it.

    The join key is (key, bucket of the offset): an interval is repeated once per bucket it
    touches and a point lives in one bucket, so no pair appears twice and one huge document
    spreads over many tasks. Column names other than ``key`` must differ.
    """
    p = points.withColumn("__b", _bucket(F.col(point), bucket))
    last = F.greatest(_bucket(F.col(end) - 1, bucket), _bucket(F.col(start), bucket))
    i = intervals.withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), bucket), last)))
    i = i.withColumnRenamed(key, "__k").withColumnRenamed("__b", "__ib")
    inside = (
        (F.col(key) == F.col("__k"))
        & (F.col("__b") == F.col("__ib"))
        & (F.col(start) <= F.col(point))
        & (F.col(point) < F.col(end))
    )
    return p.join(i, inside, how).drop("__b", "__ib", "__k")


def overlapping_spans(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str = "doc_id",
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    how: str = "inner",
    bucket: int = DEFAULT_BUCKET,
) -> DataFrame:
    """Join spans of the same key that share at least one character.

    Both sides are repeated per bucket touched; a pair is kept only in the first bucket the
    two spans have in common, which makes the pairs duplicate-free. With ``how='left'`` a left
    span also appears without a partner for every bucket that gave it none.
    """
    (ls, le), (rs, re_) = left_span, right_span

    def spread(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        last = F.greatest(_bucket(F.col(e) - 1, bucket), _bucket(F.col(s), bucket))
        return df.withColumn(name, F.explode(F.sequence(_bucket(F.col(s), bucket), last)))

    a = spread(left, ls, le, "__b")
    b = spread(right, rs, re_, "__rb").withColumnRenamed(key, "__k")
    meets = (
        (F.col(key) == F.col("__k"))
        & (F.col("__b") == F.col("__rb"))
        & (F.col(ls) < F.col(re_))
        & (F.col(rs) < F.col(le))
        & (F.col("__b") == F.greatest(_bucket(F.col(ls), bucket), _bucket(F.col(rs), bucket)))
    )
    return a.join(b, meets, how).drop("__b", "__rb", "__k")
