"""Which of many terms occur in a text, for term tables of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import cut_lineage

#: Characters of the terms (and 64 for each of them) that one automaton holds.
BLOCK_CHARS = 4_000_000


def found_terms(rows: DataFrame, text: str, keep: Sequence[str], terms: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns and ``term``: one row for each different term that a text contains, anywhere in it.

    ``terms`` has distinct, non-empty strings in ``term``. They are cut into blocks of a checked size by hash; each block is one
    automaton in the tasks and one pass over the texts, and where there are several blocks, what a pass has found is written before
    the next one. So neither the driver nor a worker ever holds more than one block. Null texts contain nothing.
    """
    size = terms.agg(F.sum(F.length("term") + 64)).collect()[0][0] or 0
    blocks, out = max(1, -(-size // block_chars)), None
    narrow = rows.select(*keep, F.col(text).alias("__text"))
    schema = narrow.drop("__text").schema.add("term", "string")
    for block in range(blocks):
        own = [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).select("term").collect()]
        found = narrow.mapInArrow(_scan(own), schema)
        found = cut_lineage(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _scan(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t in terms:
            automaton.add_word(t, t)
        if terms:
            automaton.make_automaton()
        for batch in batches:
            at, what = [], []
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                text = x.as_py()
                found = {t for _, t in automaton.iter(text)} if text and terms else ()
                at += [i] * len(found)
                what += sorted(found)
            kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(what, pa.string())], [*kept.schema.names, "term"])

    return run


def term_spans(rows: DataFrame, text: str, keep: Sequence[str], terms: DataFrame, lane: str = "term", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns, ``term``, ``char_start``, ``char_end``: where terms stand in a text, in any case and between word boundaries.

    ``terms`` has distinct lower-case strings in ``term`` and, unless every term is searched on its own, a number in ``lane``. Spans of
    one lane never overlap: the leftmost counts, of those the longest, and the search goes on behind it, as with one pattern per lane.
    Spans of different lanes may overlap. Terms are cut into blocks as in :func:`found_terms`, whole lanes together.
    """
    size = terms.agg(F.sum(F.length("term") + 64)).collect()[0][0] or 0
    blocks, out = max(1, -(-size // block_chars)), None
    narrow = rows.select(*keep, F.col(text).alias("__text"))
    schema = narrow.drop("__text").schema.add("term", "string").add("char_start", "integer").add("char_end", "integer")
    for block in range(blocks):
        own = [(r[0], r[1]) for r in terms.filter(F.pmod(F.xxhash64(lane), F.lit(blocks)) == block).select("term", F.col(lane).alias("lane")).collect()]
        found = narrow.mapInArrow(_place(own), schema)
        found = cut_lineage(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case and, where that has another length, the original offset of each character."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p] + [len(text)]


def spans_in(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms of an automaton with values (term, lane), in order; see :func:`term_spans`."""
    low, offsets = lowered(text)
    found = []
    for last, (term, lane) in automaton.iter(low):
        a, b = last + 1 - len(term), last + 1
        if (a > 0 and _is_word(low[a - 1])) != _is_word(term[0]) and (b < len(low) and _is_word(low[b])) != _is_word(term[-1]):
            found.append((a, -b, lane, term))
    found.sort(key=lambda s: s[:2])
    free, out = {}, []
    for a, b, lane, term in found:
        if a >= free.get(lane, 0):
            free[lane] = -b
            out.append((a, -b, term) if offsets is None else (offsets[a], offsets[-b], term))
    return out


def _place(terms: list[tuple[str, object]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t, lane in terms:
            automaton.add_word(t, (t, lane))
        if terms:
            automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                text = x.as_py()
                spans = spans_in(text, automaton) if text and terms else []
                at += [i] * len(spans)
                found += spans
            kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int32()))
            columns = [pa.array([s[2] for s in found], pa.string()), pa.array([s[0] for s in found], pa.int32()), pa.array([s[1] for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "term", "char_start", "char_end"])

    return run
