"""Lexicon matching with exact offsets, and the hints derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import built_once
from ..functions.sizes import broadcast_if_small, cut_lineage
from ..functions.spans import match_spans, points_in_intervals
from ..functions.terms import BLOCK_CHARS, term_spans
from ..functions.text import escape_literal, word_regex
from ..functions.wordtrie import batched_regexes
from .lexicon import condition_of, note_with_condition
from .parse import chunk_table
from .reading import plain, terms_in_chunks

DEFAULT_BATCH = 500
#: Vocabularies up to these numbers of terms are patterns of the plan; larger ones are automata in the tasks.
MAX_PATTERN_TERMS = 50_000
MAX_LOOKUP_TERMS = 5_000
HINT_CAP = 20
SAMPLES = 3


def lexicon_terms(lexicon: DataFrame, max_terms: int = MAX_PATTERN_TERMS) -> list[str] | None:
    """The vocabulary in lexicon order, read to the driver under a size check; None where it has more terms."""
    entries = lexicon_entries(lexicon)
    rows = entries.select("term", *[c for c in entries.columns if c == "ord"]).limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        return None
    return [r["term"] for r in sorted(rows, key=lambda r: (r["ord"] if "ord" in r else 0, r["term"]))]


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """Terms in lower case, blank ones dropped, and one entry per term: the first by ``ord``."""
    low = lexicon.withColumn("term", F.lower("term")).filter(F.trim("term") != "")
    others = [c for c in lexicon.columns if c != "term"]
    first = F.min_by(F.struct(*others), F.col("ord") if "ord" in others else F.xxhash64(*others))
    return low.groupBy("term").agg(first.alias("__e")).select("term", "__e.*")


def hint_entries(lexicon: DataFrame) -> dict[str, tuple[str, list[str], str]]:
    """What hints show of each entry: category, alternatives, condition. For vocabularies whose terms the driver holds already, see :func:`lexicon_terms`."""
    note = note_with_condition(F.col("note"), F.col("condition"))
    return {r[0]: tuple(r[1:]) for r in lexicon_entries(lexicon).select("term", "category", "alternatives", condition_of(note)).collect()}


def hit_array(text: Column, terms: list[str], batch_size: int = DEFAULT_BATCH) -> Column:
    """Matches of the vocabulary: array of (char_start, char_end, text), sorted by start.

    Within a batch the longest term wins and matches never overlap. Matches of different
    batches may overlap; identical spans are kept once.
    """
    if not terms:
        return F.array().cast("array<struct<char_start:int,char_end:int,text:string>>")
    found = [match_spans(text, p) for p in batched_regexes(terms, batch_size)]
    if len(found) == 1:
        return found[0]
    return F.array_distinct(F.array_sort(F.flatten(F.array(*found))))


@built_once
def _hits(terms: tuple[str, ...], batch_size: int) -> Column:
    return hit_array(F.col("text"), list(terms), batch_size)


def hits_column(terms: list[str], batch_size: int = DEFAULT_BATCH) -> Column:
    """Hits in the column ``text`` as one narrow array, for passes that compute more of the same text; see :func:`hits_of_column`."""
    return F.transform(_hits(tuple(terms), batch_size), lambda h: F.struct(h["char_start"], h["char_end"], F.lower(h["text"]).alias("term")))


def hits_of_column(rows: DataFrame, lexicon: DataFrame, name: str = "hits") -> DataFrame:
    """The table of :func:`lexicon_hits` from the arrays of :func:`hits_column`."""
    return _with_entries(rows.select("doc_id", F.inline(name)), lexicon)


def raw_hits(documents: DataFrame, terms: list[str], batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """(doc_id, char_start, char_end, term); stateless per document, so it also streams."""
    hits = documents.select("doc_id", F.explode(_hits(tuple(terms), batch_size)).alias("h"))
    return hits.select("doc_id", "h.char_start", "h.char_end", F.lower("h.text").alias("term"))


def lexicon_hits(documents: DataFrame, lexicon: DataFrame, batch_size: int = DEFAULT_BATCH, max_pattern_terms: int = MAX_PATTERN_TERMS) -> DataFrame:
    """Whole-document scan: one row per hit with the attributes of its lexicon entry, for vocabularies of any size.

    A small vocabulary is a pattern per batch. A larger one is cut into the same batches (longest terms first) and searched by
    automata, whose hits never overlap within a batch either.
    """
    terms = lexicon_terms(lexicon, max_pattern_terms)
    if terms is None:
        hits = term_spans(documents, "text", ["doc_id"], term_batches(lexicon, batch_size), "batch").select("doc_id", "char_start", "char_end", "term")
        return _with_entries(hits.distinct(), lexicon)
    return _with_entries(raw_hits(documents, terms, batch_size), lexicon)


def term_batches(lexicon: DataFrame, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """``term, batch``: terms by falling length, ties in lexicon order, numbered in batches. Only lengths meet in one task."""
    entries = lexicon_entries(lexicon)
    order = [F.col("ord"), F.col("term")] if "ord" in entries.columns else [F.col("term")]
    sized = entries.withColumn("size", F.length("term"))
    longer = sized.groupBy("size").count()
    before = longer.select("size", (F.coalesce(F.sum("count").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("size").orderBy(*order)) - 1
    return sized.join(F.broadcast(before), "size").select("term", F.floor(rank / F.lit(batch_size)).cast("long").alias("batch"))


def sliced_lexicon_hits(documents: DataFrame, lexicon: DataFrame, slices: int, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """As :func:`lexicon_hits`, by automata for a vocabulary of any size; ``slices`` is the least number of passes over the documents."""
    batches = cut_lineage(term_batches(lexicon, batch_size))
    size = batches.agg(F.sum(F.length("term") + 64)).collect()[0][0] or 0
    hits = term_spans(documents, "text", ["doc_id"], batches, "batch", block_chars=min(BLOCK_CHARS, max(1, -(-size // slices))))
    return _with_entries(hits.select("doc_id", "char_start", "char_end", "term").distinct(), lexicon)


def _with_entries(hits: DataFrame, lexicon: DataFrame) -> DataFrame:
    entry = lexicon_entries(lexicon).select(
        "term", "category", "alternatives",
        note_with_condition(F.col("note"), F.col("condition")).alias("note"),
    )
    return hits.join(broadcast_if_small(entry, MAX_PATTERN_TERMS), "term").select(
        "doc_id", "char_start", "char_end", "term", "category", "alternatives", "note"
    )


@built_once
def _term_spans(terms: tuple[str, ...]) -> Column:
    """Matches of every term on its own, in the column ``text``."""

    def spans_of(term: str) -> Column:
        return F.transform(
            match_spans(F.col("text"), word_regex(term)),
            lambda s: F.struct(F.lit(term).alias("term"), s["char_start"].alias("s"), s["char_end"].alias("e")),
        )

    if not terms:
        return F.array().cast("array<struct<term:string,s:int,e:int>>")
    return F.flatten(F.array(*[spans_of(t) for t in terms]))


def lexicon_lookup(chunks: DataFrame, lexicon: DataFrame, max_terms: int = MAX_LOOKUP_TERMS) -> DataFrame:
    """Per chunk and per term: every term is searched on its own, so matches may overlap. Vocabularies of any size."""
    entry = lexicon_entries(lexicon).select(
        "term", "category", "alternatives", note_with_condition(F.col("note"), F.col("condition")).alias("note")
    )
    terms = lexicon_terms(lexicon, max_terms=max_terms)
    if terms is None:
        placed = term_spans(chunks.withColumnRenamed("char_start", "__at"), "text", ["doc_id", "chunk_idx", "chunk_id", "__at"], entry.select("term"))
        moved = placed.withColumns({"char_start": F.col("__at") + F.col("char_start"), "char_end": F.col("__at") + F.col("char_end")}).drop("__at")
        return moved.join(broadcast_if_small(entry, MAX_PATTERN_TERMS), "term")

    # One cheap pass with the shared pattern drops the chunks that hold no term at all.
    any_term = "|".join(escape_literal(t) for t in terms)
    hits = chunks.filter(F.rlike("text", F.lit(f"(?iu){any_term}"))).select(
        "doc_id", "chunk_idx", "chunk_id", F.col("char_start").alias("__at"), F.explode(_term_spans(tuple(terms))).alias("h")
    )
    rows = hits.select(
        "doc_id", "chunk_idx", "chunk_id", F.col("h.term").alias("term"),
        (F.col("__at") + F.col("h.s")).alias("char_start"), (F.col("__at") + F.col("h.e")).alias("char_end"),
    )
    return rows.join(broadcast_if_small(entry, MAX_LOOKUP_TERMS), "term")


def document_lookup(documents: DataFrame, lexicon: DataFrame, max_terms: int = MAX_LOOKUP_TERMS) -> DataFrame:
    """:func:`lexicon_lookup` in the chunks of documents. ASCII terms are looked for in whole texts, so no chunk is made into a row."""
    terms = lexicon_terms(lexicon, max_terms=max_terms)
    if terms is None or not plain(terms):
        return lexicon_lookup(chunk_table(documents), lexicon, max_terms)
    entry = lexicon_entries(lexicon).select(
        "term", "category", "alternatives", note_with_condition(F.col("note"), F.col("condition")).alias("note")
    )
    return terms_in_chunks(documents, terms).join(broadcast_if_small(entry, MAX_LOOKUP_TERMS), "term")


def joined_lexicon_hits(documents: DataFrame, lexicon: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every term on its own, as in :func:`lexicon_lookup`, over whole documents and for vocabularies of any size.

    Hits of one term never overlap, hits of different terms may. Terms are blocks of a checked size, one pass over the texts each;
    the attributes of the entries are joined to the hits. Null texts have no hits; an empty lexicon gives none; repeated terms count once.
    """
    hits = term_spans(documents, "text", ["doc_id"], lexicon_entries(lexicon).select("term"), block_chars=block_chars)
    return _with_entries(hits, lexicon)


def term_doc_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("doc_count"))


def hits_in_window(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Each hit with every window whose span holds its start (overlap regions: two windows)."""
    w = windows.select(
        "doc_id", "window_idx", F.col("char_start").alias("window_start"), F.col("char_end").alias("window_end")
    )
    return points_in_intervals(hits, w, point="char_start", start="window_start", end="window_end")


def hint_samples(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window and term: count, first three offsets, first three alternatives, condition."""
    span = F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return hits_in_window(hits, windows).groupBy("doc_id", "window_idx", "term").agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.min("char_start").alias("first_start"),
        F.slice(F.array_sort(F.collect_list(span)), 1, SAMPLES).alias("sample_offsets"),
        F.min_by("category", "char_start").alias("category"),
        F.slice(F.min_by("alternatives", "char_start"), 1, SAMPLES).alias("alternatives"),
        condition_of(F.min_by("note", "char_start")).alias("condition"),
    )


def window_hints(hits: DataFrame, windows: DataFrame, cap: int = HINT_CAP) -> DataFrame:
    """Hints of each window, rarest term of the document first, at most ``cap``."""
    counted = hint_samples(hits, windows).join(term_doc_counts(hits), ["doc_id", "term"])
    order = Window.partitionBy("doc_id", "window_idx").orderBy("doc_count", "first_start", "term")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def hint_adjudication(hints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Exactly one verdict per hint; missing or unknown ones are ``clean``.

    ``verdicts`` has doc_id, window_idx, term, verdict and ``pos``; the last one of a term counts.
    """
    last = verdicts.filter(F.coalesce("term", F.lit("")) != "").groupBy("doc_id", "window_idx", "term").agg(
        F.max_by(F.struct("verdict"), "pos").alias("v")
    )
    joined = hints.join(last, ["doc_id", "window_idx", "term"], "left")
    return joined.select(
        "doc_id", "window_idx", "rank", "term",
        F.when(F.col("v.verdict").isin("flag", "clean"), F.col("v.verdict")).otherwise("clean").alias("verdict"),
        F.col("v").isNull().alias("filled"),
    )


PROMPT_TASK = (
    "Find wording in the passage that excludes, demeans or misstates people. "
    "Reply with a JSON object: candidates (a list) and hint_verdicts (flag or clean for each numbered term, if any)."
)
PROMPT_TERMS = "Terms of the lexicon in this passage:"


def audit_prompts(windows: DataFrame, hints: DataFrame) -> DataFrame:
    """One prompt per window: the task, a numbered line per hint, then the passage with its section."""
    per_window = hints.groupBy("doc_id", "window_idx").agg(F.array_sort(F.collect_list(F.struct("rank", _hint_line(F.col).alias("line")))).alias("lines"))
    prompt = _window_prompt(F.array_join(F.col("lines")["line"], "\n"))
    return windows.join(per_window, ["doc_id", "window_idx"], "left").select("doc_id", "window_idx", prompt.alias("prompt"))


def hinted_prompts(windows: DataFrame) -> DataFrame:
    """As :func:`audit_prompts`, for windows that have their ``hints`` with them: nothing is joined."""
    lines = F.transform("hints", lambda h: _hint_line(lambda n: h[n]))
    prompt = _window_prompt(F.when(F.size("hints") > 0, F.array_join(lines, "\n")))
    return windows.select("doc_id", "window_idx", prompt.alias("prompt"))


def _hint_line(of) -> Column:
    instead = F.when(F.size(of("alternatives")) > 0, F.concat(F.lit(" | instead: "), F.array_join(of("alternatives"), " / "))).otherwise("")
    only = F.when(of("condition") != "", F.concat(F.lit(" | only "), of("condition"))).otherwise("")
    return F.concat(of("rank").cast("string"), F.lit(". "), of("term"), F.lit(" ["), of("category"), F.lit("] x"), of("hit_count").cast("string"), instead, only)


def _window_prompt(lines: Column) -> Column:
    terms = F.concat(F.lit(PROMPT_TERMS + "\n"), lines, F.lit("\n"))
    source = F.when(F.col("heading_path") != "", F.concat(F.lit(' from "'), "heading_path", F.lit('"'))).otherwise("")
    return F.concat(F.lit(PROMPT_TASK + "\n"), F.coalesce(terms, F.lit("")), F.lit("\nPassage"), source, F.lit(":\n<passage>\n"), "text", F.lit("\n</passage>\n"))
