"""Guards and offset-exact document parsing: blocks, sentences, overlapping windows.

A parsed document stays one row. Blocks, sentences and windows are arrays computed from the
text of that row, so parsing is a narrow transformation: no shuffle, no text copied between
tasks, and it runs unchanged on a stream. ``blocks``, ``sentences`` and ``windows`` turn the
arrays into tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import built_once
from ..functions.spans import MARK, gap_spans, scan
from ..functions.text import WS, lit_let

DEFAULT_WINDOW_TOKENS = 1800
HEADING_MAX_WORDS = 12

# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "dr", "prof", "et al", "e.g", "i.e", "vs", "cf", "fig", "eq",
    "pp", "no", "vol", "ch", "sec", "approx",
)

# Shapes of headings and list items.
NUMBERED_HEADING = f"\\A(?:\\p{{Nd}}+(?:\\.\\p{{Nd}}+)+\\.?|\\p{{Nd}}+\\.|[IVXLCDM]+\\.){WS}+{T.NOT_WS}"
LIST_ITEM = f"\\A(?:[-*•]|\\p{{Nd}}+[.)]|[a-zA-Z][.)]){WS}+{T.NOT_WS}"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLOCK_BREAK = f"\\n{WS}*\\n"
_SHORT = f"\\A{T.NOT_WS}++(?:{WS}++{T.NOT_WS}++){{0,{HEADING_MAX_WORDS - 1}}}\\z"
SENTENCE_MARKS = "[.!?…]"
SENTENCE_OPENERS = "[A-Z\"'(0-9]"


# Dots and spaces around an abbreviation that a look-behind, which needs a bound, can see. Texts with longer runs take another way.
_MAX_RUN = 16
_LONG_RUN = f"[.{WS}]{{{_MAX_RUN}}}"
# The same length without a printable ASCII character but the dot: faster to look for, and every long run holds one.
_RUN_POSSIBLE = f"[^\\x21-\\x2d\\x2f-\\x7e]{{{_MAX_RUN}}}"
# A noncharacter that says "no cut behind this mark".
_NO_CUT = "\ufdd0"


def _abbreviation_marks() -> str:
    """An abbreviation and the sentence mark behind it, with any number of dots and spaces between."""
    words = "|".join(f"\\.*{WS}+\\.*".join(T.escape_literal(w) for w in a.split(" ")) for a in ABBREVIATIONS)
    return f"((?:\\A|{WS})\\.*+(?i:{words})\\.*{WS}*{SENTENCE_MARKS})(?={WS}++(?:{SENTENCE_OPENERS}|\\z))"


def _sentence_cut() -> str:
    """A sentence mark that no abbreviation precedes, then space before a sentence opener.

    Few marks stand behind the last two characters of an abbreviation; the costly look-behind is left to those.
    """
    dots, gap = f"\\.{{0,{_MAX_RUN}}}", f"{WS}{{0,{_MAX_RUN}}}"
    inner = f"{dots}{WS}{{1,{_MAX_RUN}}}{dots}"
    words = "|".join(inner.join(T.escape_literal(w) for w in a.split(" ")) for a in ABBREVIATIONS)
    opens = f"(?={WS}++(?:{SENTENCE_OPENERS}|\\z))"
    no_abbreviation = f"(?<!(?:\\A|{WS}){dots}(?i:{words}){dots}{gap}{SENTENCE_MARKS})"
    ends = "|".join(dict.fromkeys(T.escape_literal(a[-2:] if " " not in a[-2:] else a[-1]) for a in ABBREVIATIONS))
    no_ending = f"(?<!(?:[.{WS}]|(?i:{ends})){SENTENCE_MARKS})"
    return f"({SENTENCE_MARKS}){opens}(?:{no_ending}|{no_abbreviation})({WS}++)"


_SENTENCE_CUT = _sentence_cut()


def _mark_sentence_gaps(text: Column) -> Column:
    """Mark the white space between sentences.

    A look-behind keeps abbreviations together. Where a text has a run of dots or spaces that it cannot see through, the marks
    behind abbreviations are tagged first, the other ones cut, and the tags removed.
    """
    tagged = F.regexp_replace(text, _abbreviation_marks(), f"$1{_NO_CUT}")
    cut = F.regexp_replace(tagged, f"({SENTENCE_MARKS})({WS}++)(?={SENTENCE_OPENERS}|\\z)", f"$1{MARK}$2{MARK}")
    return F.when(
        F.rlike(text, F.lit(_RUN_POSSIBLE)) & F.rlike(text, F.lit(_LONG_RUN)) & ~F.contains(text, F.lit(_NO_CUT)), F.replace(cut, F.lit(_NO_CUT), F.lit(""))
    ).otherwise(F.regexp_replace(text, _SENTENCE_CUT, f"$1{MARK}$2{MARK}"))


def sentence_spans(text: Column) -> Column:
    """Sentences of one block: array of (char_start, char_end, text), relative to the block."""
    spans = gap_spans(text, _mark_sentence_gaps)
    return F.filter(spans, lambda s, i: (i == 0) | (s["text"] != ""))


def block_kind(text: Column) -> Column:
    """heading, list or paragraph; the heading test comes first."""
    return lit_let(T.strip(text), _kind_of_stripped)


def _kind_of_stripped(stripped: Column) -> Column:
    open_end = ~F.right(stripped, F.lit(1)).isin(".", "!", "?")
    all_caps = ~F.rlike(stripped, F.lit("[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]")) & F.rlike(
        stripped, F.lit("(?s)\\p{Lu}.*\\p{Lu}")
    )
    heading = (
        (stripped != "")
        & ~F.contains(stripped, F.lit("\n"))
        & F.rlike(stripped, F.lit(_SHORT))
        & (open_end | F.rlike(stripped, F.lit(NUMBERED_HEADING)) | all_caps)
    )
    lines = F.filter(F.transform(F.split(stripped, LINE_BREAK), T.strip), lambda ln: ln != "")
    is_list = F.rlike(stripped, F.lit(LIST_ITEM)) & F.forall(lines, lambda ln: F.rlike(ln, F.lit(LIST_ITEM)))
    return F.when(heading, "heading").when(is_list, "list").otherwise("paragraph")


def block_array(text: Column) -> Column:
    """Blocks between blank lines: array of (block_idx, kind, text, char_start, char_end)."""
    raw = gap_spans(text, lambda t: F.regexp_replace(t, f"({BLOCK_BREAK})", f"{MARK}$1{MARK}"))

    def trimmed(s: Column) -> Column:
        start = s["char_start"] + F.length(s["text"]) - F.length(T.lstrip(s["text"]))
        return lit_let(
            F.struct(T.strip(s["text"]).alias("t"), start.alias("s")),
            lambda b: F.struct(
                b["t"].alias("text"), b["s"].alias("char_start"), (b["s"] + F.length(b["t"])).alias("char_end")
            ),
        )

    kept = F.filter(F.transform(raw, trimmed), lambda b: b["text"] != "")
    return F.transform(
        kept,
        lambda b, i: F.struct(
            i.alias("block_idx"), block_kind(b["text"]).alias("kind"), b["text"].alias("text"),
            b["char_start"].alias("char_start"), b["char_end"].alias("char_end"),
        ),
    )


def _run_starts(numbers: Column) -> Column:
    """Positions where a non-decreasing numbering changes, the first included."""
    return F.filter(
        F.transform(
            numbers,
            lambda n, i: F.when((i == 0) | (F.get(numbers, i - 1) != n), i),
        ),
        lambda i: i.isNotNull(),
    )


def _block_segments(block: Column, budget: float) -> Column:
    """A block as atomic segments: itself, or groups of its sentences when over budget."""

    def segment(text: Column, start: Column, end: Column, tokens: Column) -> Column:
        return F.struct(
            start.alias("char_start"), end.alias("char_end"), block["kind"].alias("kind"),
            block["block_idx"].alias("block_idx"), text.alias("text"), tokens.alias("tokens"),
        )

    def grouped(sents: Column) -> Column:
        numbers = scan(
            F.transform(sents, lambda s: T.token_estimate(s["text"])),
            F.struct(F.lit(0).alias("g"), F.lit(0.0).alias("tok"), F.lit(0).alias("n")),
            lambda st, x: lit_let(
                (st["n"] > 0) & (st["tok"] + x > budget),
                lambda full: F.struct(
                    (st["g"] + full.cast("int")).alias("g"),
                    F.when(full, x).otherwise(st["tok"] + x).alias("tok"),
                    F.lit(1).alias("n"),
                ),
            ),
            lambda st: st["g"],
            "int",
        )

        def cut(starts: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                last = F.coalesce(F.get(starts, i + 1) - 1, F.size(sents) - 1)
                a, b = F.get(sents, s)["char_start"], F.get(sents, last)["char_end"]
                return lit_let(
                    F.substring(block["text"], a + 1, b - a),
                    lambda t: segment(t, block["char_start"] + a, block["char_start"] + b, T.token_estimate(t)),
                )

            return F.transform(starts, one)

        return lit_let(lit_let(numbers, _run_starts), cut)

    return lit_let(
        T.token_estimate(block["text"]),
        lambda tokens: F.when(
            tokens <= budget, F.array(segment(block["text"], block["char_start"], block["char_end"], tokens))
        ).otherwise(lit_let(sentence_spans(block["text"]), grouped)),
    )


def segment_array(blocks: Column, window_tokens: int) -> Column:
    budget = float(window_tokens)
    return F.flatten(F.transform(blocks, lambda b: _block_segments(b, budget)))


def _placed(budget: float):
    """One step of the greedy placement: state ``w`` (window), ``tok``, ``n``, ``h`` (last heading) and a segment ``tokens, kind, i``."""

    def step(st: Column, x: Column) -> Column:
        full = (st["n"] > 0) & (
            (st["tok"] + x["tokens"] > budget) | ((x["kind"] == "heading") & (st["tok"] >= budget * 0.5))
        )
        return lit_let(
            full,
            lambda f: F.struct(
                (st["w"] + f.cast("int")).alias("w"),
                F.when(f, x["tokens"]).otherwise(st["tok"] + x["tokens"]).alias("tok"),
                F.lit(1).alias("n"),
                F.when(x["kind"] == "heading", x["i"]).otherwise(st["h"]).alias("h"),
            ),
        )

    return step


_NOT_PLACED = (("w", 0), ("tok", 0.0), ("n", 0), ("h", -1))


def _start() -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in _NOT_PLACED])


def _slim(segs: Column) -> Column:
    return F.transform(segs, lambda s, i: F.struct(s["tokens"].alias("tokens"), s["kind"].alias("kind"), i.alias("i")))


def window_count(segments: Column, window_tokens: int) -> Column:
    """The number of windows that :func:`window_array` makes, without making them."""
    return F.aggregate(_slim(segments), _start(), _placed(float(window_tokens)), lambda st: F.when(st["n"] > 0, st["w"] + 1).otherwise(0))


def window_array(segments: Column, window_tokens: int) -> Column:
    """Greedy windows over segments, each starting with the overlap of the one before."""
    step = _placed(float(window_tokens))

    def build(segs: Column) -> Column:
        placed = scan(
            _slim(segs), _start(), step, lambda st: F.struct(st["w"].alias("w"), st["h"].alias("h")), "struct<w:int,h:int>"
        )

        def from_starts(p: Column) -> Column:
            own = lit_let(
                lit_let(F.transform(p, lambda s: s["w"]), _run_starts),
                lambda starts: F.transform(
                    starts,
                    lambda s, i: lit_let(
                        F.coalesce(F.get(starts, i + 1), F.size(segs)),
                        lambda stop: F.struct(
                            F.slice(segs, s + 1, stop - s).alias("segs"),
                            F.get(p, stop - 1)["h"].alias("h"),
                        ),
                    ),
                ),
            )
            return lit_let(own, lambda ws: F.transform(ws, lambda w, i: _window(ws, w, i, segs)))

        return lit_let(placed, from_starts)

    return lit_let(segments, build)


def _window(ws: Column, w: Column, i: Column, segs: Column) -> Column:
    def overlap_of(prev: Column) -> Column:
        paragraphs = F.filter(prev, lambda s: s["kind"] == "paragraph")
        return F.when(F.exists(prev, lambda s: s["kind"] == "paragraph"), F.slice(paragraphs, -1, 1)).otherwise(
            F.slice(prev, -1, 1)
        )

    overlap = F.when(i > 0, overlap_of(F.get(ws, i - 1)["segs"])).otherwise(F.slice(w["segs"], 1, 0))

    def assemble(parts: Column) -> Column:
        all_segs = F.concat(parts, w["segs"])
        start = F.get(all_segs, F.lit(0))["char_start"]
        return F.struct(
            i.alias("window_idx"),
            F.concat(F.lit("w"), F.format_string("%03d", i)).alias("window_id"),
            F.array_join(F.transform(all_segs, lambda s: s["text"]), "\n\n").alias("text"),
            start.alias("char_start"),
            F.element_at(w["segs"], -1)["char_end"].alias("char_end"),
            F.coalesce(F.when(w["h"] >= 0, F.get(segs, w["h"])["text"]), F.lit("")).alias("heading_path"),
            F.transform(all_segs, lambda s: s["block_idx"]).alias("block_idxs"),
            F.coalesce(F.get(parts, F.lit(0))["char_end"], start).alias("overlap_char_end"),
        )

    return lit_let(overlap, assemble)


def sentence_array(blocks: Column) -> Column:
    """Sentences of paragraph and list blocks, numbered through the document."""
    per_block = F.flatten(
        F.transform(
            F.filter(blocks, lambda b: b["kind"] != "heading"),
            lambda b: F.transform(
                sentence_spans(b["text"]),
                lambda s: F.struct(
                    s["text"].alias("text"), (b["char_start"] + s["char_start"]).alias("char_start"),
                    (b["char_start"] + s["char_end"]).alias("char_end"), b["block_idx"].alias("block_idx"),
                ),
            ),
        )
    )
    return F.transform(
        per_block,
        lambda s, i: F.struct(
            i.alias("sentence_idx"), numbered("s", i, 4).alias("sentence_id"), s["text"].alias("text"),
            s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), s["block_idx"].alias("block_idx"),
        ),
    )


def numbered(prefix: str, n: Column, width: int) -> Column:
    """``s0007``-style identifiers; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", n)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, however often later columns use it.

    Spark may inline a projected expression into each of its uses; a generator is a border
    that projections are not pushed through.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


# ---- guards ------------------------------------------------------------------------


def guard_nonempty(documents: DataFrame) -> DataFrame:
    return documents.filter(~T.is_blank(F.col("text")))


def guard_english(documents: DataFrame) -> DataFrame:
    return documents.filter(T.is_english(F.col("text")))


def guard_verdicts(documents: DataFrame) -> DataFrame:
    """Every document with the reason it is rejected for, or null."""
    return documents.withColumn(
        "reason",
        F.when(T.is_blank(F.col("text")), "empty").when(~T.is_english(F.col("text")), "not_english"),
    )


def guard_window_cap(parsed: DataFrame, max_windows: int | None = None) -> DataFrame:
    """Keep documents of at most ``max_windows`` windows (parsed rows hold the array); all of them without a cap."""
    return parsed if max_windows is None else parsed.filter(F.size("windows") <= max_windows)


def window_cap_rejects(parsed: DataFrame, max_windows: int) -> DataFrame:
    """The documents that a cap keeps out, with the reason and their number of windows."""
    over = parsed.select("doc_id", F.size("windows").alias("n_windows")).filter(F.col("n_windows") > max_windows)
    return over.select("doc_id", F.lit("too_many_windows").alias("reason"), "n_windows")


# ---- parsed documents and their tables -------------------------------------------------


@built_once
def _blocks() -> Column:
    return block_array(F.col("text"))


@built_once
def _segments(window_tokens: int) -> Column:
    return segment_array(F.col("blocks"), window_tokens)


@built_once
def _windows(window_tokens: int) -> Column:
    return window_array(_segments(window_tokens), window_tokens)


@built_once
def window_count_of_blocks(window_tokens: int) -> Column:
    return window_count(_segments(window_tokens), window_tokens)


@built_once
def windows_of_blocks(window_tokens: int) -> Column:
    return _windows(window_tokens)


@built_once
def sentences_of_blocks() -> Column:
    return sentence_array(F.col("blocks"))


def parse_blocks(documents: DataFrame) -> DataFrame:
    return pin(documents, "blocks", _blocks())


def parse_documents(
    documents: DataFrame, window_tokens: int = DEFAULT_WINDOW_TOKENS, *, sentences: bool = True
) -> DataFrame:
    """Add ``blocks``, ``windows`` and (on request) ``sentences`` arrays to each document."""
    out = pin(parse_blocks(documents), "windows", _windows(window_tokens))
    return pin(out, "sentences", sentences_of_blocks()) if sentences else out


def block_table(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline(_blocks()))


def sentence_table(documents: DataFrame) -> DataFrame:
    return parse_blocks(documents).select("doc_id", F.inline(sentences_of_blocks()))


def segment_table(documents: DataFrame, window_tokens: int = DEFAULT_WINDOW_TOKENS) -> DataFrame:
    return parse_blocks(documents).select(
        "doc_id", F.posexplode(_segments(window_tokens)).alias("segment_idx", "s")
    ).select("doc_id", "segment_idx", "s.*")


def window_table(documents: DataFrame, window_tokens: int = DEFAULT_WINDOW_TOKENS) -> DataFrame:
    return parse_blocks(documents).select("doc_id", F.inline(_windows(window_tokens)))


def window_offsets(documents: DataFrame, window_tokens: int = DEFAULT_WINDOW_TOKENS) -> DataFrame:
    """Windows without their text, for joins on offsets."""
    return window_table(documents, window_tokens).select(
        "doc_id", "window_idx", "window_id", "char_start", "char_end", "heading_path", "overlap_char_end"
    )


def _misplaced(items: Column) -> Column:
    return F.filter(
        items,
        lambda s: F.substring(F.col("text"), s["char_start"] + 1, s["char_end"] - s["char_start"]) != s["text"],
    )


def roundtrip_violations(documents: DataFrame) -> DataFrame:
    """Blocks and sentences whose text is not the slice their offsets name; must be empty."""

    def bad(items: Column, kind: str) -> Column:
        return F.transform(
            _misplaced(items),
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end")
            ),
        )

    parsed = pin(parse_blocks(documents), "sentences", sentences_of_blocks())
    return parsed.select(
        "doc_id", F.inline(F.concat(bad(F.col("blocks"), "block"), bad(F.col("sentences"), "sentence")))
    )


def roundtrip_counts(documents: DataFrame) -> DataFrame:
    """``kind, n, violations``: blocks and sentences, and how many are not the slice their offsets name, in one pass over the texts."""
    parsed = pin(parse_blocks(documents), "sentences", sentences_of_blocks())

    def counted(kind: str, items: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.size(items).alias("n"), F.size(_misplaced(F.col(items))).alias("violations"))

    per_text = parsed.select(F.inline(F.array(counted("block", "blocks"), counted("sentence", "sentences"))))
    return per_text.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("violations").alias("violations"))


@built_once
def _chunks() -> Column:
    cut = f"(?<=[.!?]){WS}++(?=[A-Z])"
    spans = gap_spans(T.strip(F.col("text")), lambda t: F.regexp_replace(t, f"({cut})", f"{MARK}$1{MARK}"))
    return F.filter(spans, lambda s: s["text"] != "")


def chunk_table(documents: DataFrame, context_chars: int = 80) -> DataFrame:
    """Simple sentence chunks with context: a split at .!? before a capital, no abbreviations."""
    lead = F.length("text") - F.length(T.lstrip(F.col("text")))
    start, end = F.col("c.char_start") + F.col("lead"), F.col("c.char_end") + F.col("lead")
    before = F.greatest(F.lit(0), start - context_chars)
    exploded = guard_nonempty(documents).select(
        "doc_id", "text", lead.alias("lead"), F.posexplode(_chunks()).alias("chunk_idx", "c")
    )
    return exploded.select(
        "doc_id", "chunk_idx", numbered("c", F.col("chunk_idx"), 3).alias("chunk_id"),
        F.col("c.text").alias("text"),
        F.substring(F.col("text"), before + 1, start - before).alias("context_before"),
        F.substring(F.col("text"), end + 1, F.lit(context_chars)).alias("context_after"),
        start.alias("char_start"), end.alias("char_end"),
    )

