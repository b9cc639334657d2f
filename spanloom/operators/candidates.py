"""Candidate findings: detection, verification against the raw text, grouping, context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import built_once
from ..functions.responses import response_object
from ..functions.spans import match_spans, points_in_intervals
from ..functions.text import WS, lit_let
from .lexicon import CATEGORIES, DEFAULT_CATEGORY
from .parse import (
    DEFAULT_WINDOW_TOKENS, guard_english, guard_nonempty, guard_window_cap,
    numbered, parse_blocks, parse_documents, pin, sentences_of_blocks, window_count_of_blocks, windows_of_blocks,
)
from .reading import plain, read_texts

VERIFY_SLACK = 200


class Rule(NamedTuple):
    """One flag word of the rule policy."""

    word: str
    category: str
    replacement: str


# The rule policy that stands in for a model.
DEFAULT_RULES = (
    Rule("chairman", "gendered", "chairperson"),
    Rule("manpower", "exclusionary", "workforce"),
    Rule("freshmen", "exclusionary", "first-year students"),
    Rule("blacklist", "exclusionary", "blocklist"),
    Rule("his", "gendered", "their"),
    Rule("he", "gendered", "they"),
)

_CANDIDATE = (
    "struct<window_idx:int,pos:int,quote:string,category:string,reason:string,lexicon_backed:boolean,"
    "window_start:int,window_end:int>"
)


# ---- rules ---------------------------------------------------------------------------


def rule_detect_array(windows: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """One candidate per window and distinct flag word, quoting its first match as written.

    A pattern only runs where its word stands in the lower-cased window at all.
    """

    def quote_of(w: Column, low: Column, word: str) -> Column:
        found = F.regexp_extract(w["text"], T.word_regex(word), 0)
        return F.when(F.contains(low, F.lit(word.lower())), found).otherwise("") if word.isascii() else found

    def in_window(w: Column) -> Column:
        def all_rules(low: Column) -> Column:
            return F.array(*[
                F.struct(
                    w["window_idx"].alias("window_idx"), F.lit(i).alias("pos"), quote_of(w, low, r.word).alias("quote"),
                    F.lit(r.category).alias("category"), F.lit(f"contains: {r.word}").alias("reason"),
                    F.lit(True).alias("lexicon_backed"), w["char_start"].alias("window_start"),
                    w["char_end"].alias("window_end"),
                ).cast(_CANDIDATE)
                for i, r in enumerate(rules)
            ])

        return F.filter(lit_let(F.lower(w["text"]), all_rules), lambda c: c["quote"] != "")

    if not rules:
        return F.array().cast(f"array<{_CANDIDATE}>")
    return F.flatten(F.transform(windows, in_window))


def holds_rule_word(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Whether any flag word stands in a text. Windows and blocks end at white space, so where no word does, no window has a candidate.

    A word with white space in it could also span two blocks of a window; with such a rule every text is taken to hold one.
    """
    if any(ch.isspace() for r in rules for ch in r.word):
        return F.lit(True)

    def found(low: Column) -> Column:
        tests = [(F.contains(low, F.lit(r.word.lower())) if r.word.isascii() else F.lit(True)) & F.rlike(text, F.lit(T.word_regex(r.word))) for r in rules]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    return lit_let(F.lower(text), found)


def rule_classify(spans: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """flag or skip per span; gendered wins over exclusionary, reason is the first word in order."""
    hits = F.filter(
        F.array(*[F.when(F.rlike(text, F.lit(T.word_regex(r.word))), F.lit(r.word)) for r in rules]),
        lambda w: w.isNotNull(),
    )
    gendered = [r.word for r in rules if r.category == "gendered"]
    out = pin(spans, "__hits", hits)
    flagged = F.size("__hits") > 0
    return out.select(
        *spans.columns,
        F.when(flagged, "flag").otherwise("skip").alias("label"),
        F.when(
            flagged,
            F.when(F.arrays_overlap("__hits", F.array(*[F.lit(g) for g in gendered])), "gendered").otherwise("exclusionary"),
        ).alias("flag_category"),
        F.when(flagged, F.concat(F.lit("contains: "), F.array_min("__hits"))).otherwise("no trigger").alias("reason"),
    )


def rule_rewrite(col: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Replace flag words by their alternative, in rule order, ignoring case."""
    return reduce(lambda c, r: F.regexp_replace(c, T.word_regex(r.word), r.replacement), rules, col)


def normalize_category(col: Column) -> Column:
    """One of the known categories; ``_``, ``-`` and space are the same, unknown is the default."""
    key = F.translate(F.lower(T.strip(col.cast("string"))), "_-", "  ")
    out = F.lit(DEFAULT_CATEGORY)
    for c in CATEGORIES:
        out = F.when(key == c.replace("-", " "), F.lit(c)).otherwise(out)
    return out


def normalize_label(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("skip")))
    return (
        F.when(col.isin("flag", "ask", "skip"), col)
        .when(F.startswith(low, F.lit("flag")), "flag")
        .when(F.startswith(low, F.lit("ask")), "ask")
        .otherwise("skip")
    )


# ---- model responses -------------------------------------------------------------------

_AUDIT_REPLY = (
    "candidates array<struct<quote:string,category:string,reason:string,lexicon_backed:string>>,"
    "hint_verdicts array<struct<term:string,verdict:string>>"
)


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``reply`` (JSON object text or null) and ``parse_failed`` to response rows."""
    out = responses if "reply" in responses.columns else responses.withColumn("reply", response_object(F.col(raw)))
    return out.withColumn("parse_failed", F.col("reply").isNull())


def candidate_normalize(parsed: DataFrame) -> DataFrame:
    """Candidates of parsed audit replies (doc_id, window_idx, reply): one row each."""
    reply = F.from_json("reply", _AUDIT_REPLY)
    rows = parsed.filter("NOT parse_failed").select(
        "doc_id", "window_idx", F.posexplode(reply["candidates"]).alias("pos", "c")
    )
    return rows.filter(F.coalesce("c.quote", F.lit("")) != "").select(
        "doc_id", "window_idx", "pos", F.col("c.quote").alias("quote"),
        normalize_category(F.col("c.category")).alias("category"),
        F.coalesce("c.reason", F.lit("")).alias("reason"),
        (~F.coalesce("c.lexicon_backed", F.lit("false")).isin("false", "", "0", "null", "[]", "{}")).alias("lexicon_backed"),
    )


def reply_verdicts(parsed: DataFrame) -> DataFrame:
    """Hint verdicts of parsed audit replies, with their position in the reply."""
    reply = F.from_json("reply", _AUDIT_REPLY)
    return parsed.filter("NOT parse_failed").select(
        "doc_id", "window_idx", F.posexplode(reply["hint_verdicts"]).alias("pos", "v")
    ).select("doc_id", "window_idx", "pos", "v.term", "v.verdict")


# ---- quote verification ------------------------------------------------------------------

_NO_SPAN = "struct<char_start:int,char_end:int>"


def find_quote(text: Column, quote: Column, search_start: Column) -> Column:
    """Span of ``quote`` at or after ``search_start``: exact, else with any white space; or null."""
    at = F.position(quote, text, search_start + 1)
    # The loose search only runs where every word of the quote occurs at all.
    words = F.filter(F.split(T.strip(quote), WS + "+"), lambda w: w != "")
    could_match = (T.strip(quote) != "") & F.forall(words, lambda w: F.contains(text, w))

    def loose() -> Column:
        pattern = F.concat(F.lit("(?s)\\A(.*?)("), T.phrase_regex(quote), F.lit(")"))
        tail = F.substring(text, search_start + 1, F.length(text))
        gap = F.call_function("regexp_extract", tail, pattern, F.lit(1))
        hit = F.call_function("regexp_extract", tail, pattern, F.lit(2))
        return lit_let(
            F.struct(F.length(gap).alias("g"), F.length(hit).alias("h")),
            lambda m: F.when(
                m["h"] > 0,
                F.struct(
                    (search_start + m["g"]).alias("char_start"), (search_start + m["g"] + m["h"]).alias("char_end")
                ),
            ),
        )

    return lit_let(
        at,
        lambda a: F.when(
            a > 0, F.struct((a - 1).alias("char_start"), (a - 1 + F.length(quote)).alias("char_end"))
        ).when(could_match, loose()),
    )


def verify_array(text: Column, candidates: Column, slack: int = VERIFY_SLACK) -> Column:
    """Candidates with the span of their quote; ``accepted`` when it starts near its window."""

    def one(c: Column) -> Column:
        return lit_let(
            find_quote(text, c["quote"], c["window_start"]),
            lambda f: F.struct(
                c["window_idx"].alias("window_idx"), c["pos"].alias("pos"), c["category"].alias("category"),
                c["reason"].alias("reason"), c["lexicon_backed"].alias("lexicon_backed"),
                f["char_start"].alias("char_start"), f["char_end"].alias("char_end"),
                F.substring(text, f["char_start"] + 1, f["char_end"] - f["char_start"]).alias("quote"),
                F.coalesce(f["char_start"] < c["window_end"] + slack, F.lit(False)).alias("accepted"),
            ),
        )

    return F.transform(candidates, one)


def expanded_occurrences(text: Column, quote: Column, *, word_boundary: bool = False) -> Column:
    """Every place the words of ``quote`` stand in the text, whatever case and spacing.

    As an audit applies a confirmed phrase everywhere it is written, there are no word
    boundaries unless asked for: ``he`` is found inside ``the`` too.
    """
    body = T.phrase_regex(quote)
    pattern = (
        F.concat(F.lit(f"(?iu)(?<!{T.WORD})(?:"), body, F.lit(f")(?!{T.WORD})")) if word_boundary
        else F.concat(F.lit("(?iu)"), body)
    )
    spans = F.transform(
        match_spans(text, pattern),
        lambda s: F.struct(s["char_start"].alias("char_start"), s["char_end"].alias("char_end")),
    )
    return F.when(T.strip(quote) != "", spans).otherwise(F.array().cast(f"array<{_NO_SPAN}>"))


# ---- the audit of a document -----------------------------------------------------------------


def span_holding(spans: Column, at: Column) -> Column:
    """The one of sorted, disjoint ``spans`` that holds a position, or null. Found by bisection, so a document costs its candidates
    times the logarithm of its spans."""

    def halve(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        return lit_let(
            F.floor((lo + hi) / 2).cast("int"),
            lambda mid: F.when(lo >= hi, F.struct(lo.alias("lo"), hi.alias("hi")))
            .when(F.get(spans, mid)["char_start"] <= at, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda s: F.get(spans, s["lo"] - 1))
    return lit_let(last, lambda s: F.when(at < s["char_end"], s))


def _with_context(text: Column, sentences: Column, blocks: Column, candidates: Column) -> Column:
    """Attach sentence and paragraph to each verified candidate."""

    def one(c: Column) -> Column:
        sentence = span_holding(sentences, c["char_start"])
        block = span_holding(blocks, c["char_start"])
        return lit_let(
            sentence,
            lambda s: F.struct(
                c.alias("c"), s["sentence_id"].alias("sentence_id"),
                F.coalesce(s["text"], c["quote"]).alias("sentence_text"),
                F.coalesce(
                    F.when(s.isNotNull(), F.get(blocks, s["block_idx"])["text"]), block["text"], c["quote"]
                ).alias("paragraph_text"),
            ),
        )

    return F.transform(candidates, one)


@built_once
def _flagged(rules: tuple[Rule, ...]) -> Column:
    return holds_rule_word(F.col("text"), rules)


_FOUND_TYPE = (
    "struct<window_idx:int,pos:int,category:string,reason:string,lexicon_backed:boolean,char_start:int,char_end:int,quote:string,accepted:boolean>"
)


@built_once
def _found(rules: tuple[Rule, ...]) -> Column:
    return verify_array(F.col("text"), rule_detect_array(F.col("windows"), rules))


def _accepted() -> Column:
    return F.filter("found", lambda c: c["accepted"])


@built_once
def _expansions() -> Column:
    """Each distinct quote is looked up once per document, however many windows repeat it."""
    return lit_let(
        F.array_distinct(F.transform(_accepted(), lambda c: quote_key(c["quote"]))),
        lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: expanded_occurrences(F.col("text"), k))),
    )


_FOUND = ("window_idx", "pos", "quote", "char_start", "char_end", "category", "reason", "lexicon_backed")


@built_once
def _candidates(expand: bool = True, context: bool = True) -> Column:
    """Accepted candidates with context; sentences are only cut where there are candidates, and not at all without ``context``."""
    if not context:
        return F.transform(
            _accepted(),
            lambda c: F.struct(*[c[n].alias(n) for n in _FOUND], *([F.element_at("expansions", quote_key(c["quote"])).alias("expanded")] if expand else [])),
        )
    context = F.when(
        F.size(_accepted()) > 0,
        lit_let(sentences_of_blocks(), lambda ss: _with_context(F.col("text"), ss, F.col("blocks"), _accepted())),
    )
    return F.transform(
        context,
        lambda x: F.struct(
            *[x["c"][n].alias(n) for n in _FOUND],
            x["sentence_id"].alias("sentence_id"), x["sentence_text"].alias("sentence_text"),
            x["paragraph_text"].alias("paragraph_text"),
            *([F.element_at("expansions", quote_key(x["c"]["quote"])).alias("expanded")] if expand else []),
        ),
    )


def read_in_python(rules: Sequence[Rule]) -> bool:
    """Whether :func:`.reading.read_texts` stands in for the column expressions: for rules of single ASCII words."""
    return plain(r.word for r in rules) and not any(ch.isspace() for r in rules for ch in r.word)


def audit_documents(
    documents: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    *,
    window_tokens: int = DEFAULT_WINDOW_TOKENS,
    max_windows: int | None = None,
    expand: bool = True,
    extra: dict[str, Column] | None = None,
    context: bool = True,
    flagged_only: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Guards, parse, rule detection and quote verification; one narrow row per document.

    Everything is computed inside the row that holds the text, so the text is read once and
    never shuffled. Columns: doc_id, n_windows, n_raw, n_dropped, n_failed, candidates (array), and ``extra`` ones that are made
    of the columns of the pass (text, blocks, windows, found). Without ``expand`` candidates have no ``expanded`` occurrences, without
    ``context`` neither sentence nor paragraph. With ``flagged_only`` documents without any flag word, which have no candidate, are left
    out before they are parsed. Texts that pass the guards are dealt out to ``tasks`` tasks, if given, as files may be few and uneven.

    Rules of single ASCII words are looked for in Python (:func:`.reading.read_texts`), unless ``extra`` needs the columns of the pass. There only the
    first candidate of a phrase has its ``expanded`` occurrences, which :func:`recurrence_group` hands on.
    """
    kept = guard_nonempty(documents)
    if not extra and read_in_python(rules):
        guarded = guard_english(kept).select("doc_id", "text")
        return read_texts(
            guarded if tasks is None else guarded.repartition(tasks, "doc_id"), window_tokens=window_tokens, rules=rules, expand=expand, context=context, flagged_only=flagged_only,
            max_windows=max_windows, slack=VERIFY_SLACK,
        )
    if flagged_only:
        kept = kept.filter(_flagged(tuple(rules)))
    guarded = guard_english(kept).select("doc_id", "text")
    if tasks is not None:
        guarded = guarded.repartition(tasks, "doc_id")
    if extra or max_windows is not None:
        parsed = guard_window_cap(parse_documents(guarded, window_tokens, sentences=False), max_windows)
        return _narrow(pin(parsed, "found", _found(tuple(rules))), F.lit(0), expand, extra, context)
    blocks = pin(parse_blocks(guarded), "flagged", F.lit(True) if flagged_only else _flagged(tuple(rules)))
    windows = pin(blocks, "windows", F.when(F.col("flagged"), windows_of_blocks(window_tokens)))
    none = F.array().cast(f"array<{_FOUND_TYPE}>")
    found = pin(windows, "found", F.when(F.col("flagged"), _found(tuple(rules))).otherwise(none))
    counted = F.when(F.col("flagged"), F.size("windows")).otherwise(window_count_of_blocks(window_tokens))
    return _narrow(pin(found, "n_windows", counted), F.lit(0), expand, None, context, F.col("n_windows"))


def audit_replies(documents: DataFrame, parsed: DataFrame, *, window_tokens: int = DEFAULT_WINDOW_TOKENS, expand: bool = True, context: bool = True) -> DataFrame:
    """The audit with a model's replies in place of the rules: ``parsed`` as made by :func:`parse_responses`.

    The replies of a document become one array, which meets the document once; from there on everything is computed inside the
    row that holds the text (:func:`.reading.read_texts`). Documents without replies have no candidates. Columns as in :func:`audit_documents`;
    ``n_failed`` counts the replies without a JSON object.
    """
    item = F.struct("window_idx", "pos", "quote", "category", "reason", "lexicon_backed")
    said = candidate_normalize(parsed).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("said"))
    failed = parsed.groupBy("doc_id").agg(F.count_if("parse_failed").cast("int").alias("n_failed"))
    guarded = guard_english(guard_nonempty(documents)).select("doc_id", "text")
    met = guarded.join(failed.join(said, "doc_id", "left"), "doc_id", "left")
    return read_texts(met, window_tokens=window_tokens, replied=True, expand=expand, context=context, slack=VERIFY_SLACK)


def _narrow(
    found: DataFrame, n_failed: Column, expand: bool = True, extra: dict[str, Column] | None = None, context: bool = True, n_windows: Column | None = None,
) -> DataFrame:
    """What leaves the text pass, from verified candidates ``found`` of a parsed document."""
    if expand:
        found = pin(found, "expansions", _expansions())
    return pin(found, "candidates", _candidates(expand, context)).select(
        "doc_id", (F.size("windows") if n_windows is None else n_windows).alias("n_windows"), F.size("found").alias("n_raw"),
        F.size(F.filter("found", lambda c: ~c["accepted"])).alias("n_dropped"), n_failed.alias("n_failed"), "candidates",
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def verify_quotes(candidates: DataFrame, windows: DataFrame, documents: DataFrame) -> DataFrame:
    """Verification for candidates that come as a table, e.g. from a model.

    Candidates meet their document once, as one array per document; every row keeps its span
    and ``accepted``.
    """
    w = windows.select("doc_id", "window_idx", F.col("char_start").alias("window_start"), F.col("char_end").alias("window_end"))
    item = F.struct("window_idx", "pos", "quote", "category", "reason", "lexicon_backed", "window_start", "window_end")
    per_doc = candidates.join(w, ["doc_id", "window_idx"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(item)).alias("cands")
    )
    joined = documents.select("doc_id", "text").join(per_doc, "doc_id")
    return joined.select("doc_id", F.inline(verify_array(F.col("text"), F.col("cands"))))


def verified_candidates(audited: DataFrame) -> DataFrame:
    return audited.select("doc_id", F.inline("candidates"))


def attach_sentence(points: DataFrame, sentences: DataFrame, point: str = "char_start") -> DataFrame:
    """Add ``sentence_id`` of the sentence that holds the offset, null where none does."""
    s = sentences.select("doc_id", "sentence_id", F.col("char_start").alias("s_start"), F.col("char_end").alias("s_end"))
    return points_in_intervals(points, s, point=point, start="s_start", end="s_end", how="left").drop("s_start", "s_end")


def overlap_dedupe(candidates: DataFrame) -> DataFrame:
    """Identical spans once, the first in (window, position) order."""
    order = Window.partitionBy("doc_id", "char_start", "char_end").orderBy("window_idx", "pos")
    return candidates.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def quote_key(col: Column) -> Column:
    return F.lower(T.collapse_ws(col))


def recurrence_group(candidates: DataFrame) -> DataFrame:
    """Equal quotes of a document become one candidate with all occurrences.

    The primary is the one with the smallest offset; ids follow the order of first sight.
    """
    rest = [c for c in candidates.columns if c not in ("doc_id", "expanded")]
    # The same for all quotes of a group, of which maybe one has them; too long to go with each.
    grown = [F.first("expanded", ignorenulls=True).alias("expanded")] if "expanded" in candidates.columns else []
    grouped = candidates.groupBy("doc_id", quote_key(F.col("quote")).alias("quote_key")).agg(
        F.min_by(F.struct(*rest), F.struct("char_start", "window_idx", "pos")).alias("p"),
        F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("occurrences"),
        F.min(F.struct("window_idx", "pos")).alias("first_seen"), *grown,
    )
    order = Window.partitionBy("doc_id").orderBy("first_seen")
    out = grouped.withColumn("cand_idx", (F.row_number().over(order) - 1).cast("int"))
    return out.select(
        "doc_id", "cand_idx", numbered("cand", F.col("cand_idx"), 4).alias("cand_id"), "quote_key",
        *[F.col(f"p.{c}").alias(c) for c in rest], *(["expanded"] if grown else []), "occurrences",
    )


def candidates_of(audited: DataFrame) -> DataFrame:
    """Deduplicated, grouped and numbered candidates of audited documents. Dealt out by document first, all three steps share one shuffle."""
    return recurrence_group(overlap_dedupe(verified_candidates(audited).repartition("doc_id")))


def audit_stats(audited: DataFrame, candidates: DataFrame, hint_counts: DataFrame | None = None) -> DataFrame:
    """Per document: windows, hints, raw candidates, dropped, candidates, failed windows."""
    n = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    out = audited.join(n, "doc_id", "left")
    hints = F.lit(0)
    if hint_counts is not None:
        out, hints = out.join(hint_counts, "doc_id", "left"), F.coalesce("n_hints", F.lit(0))
    return out.select(
        "doc_id", F.col("n_windows").alias("windows"), hints.alias("hints"), F.col("n_raw").alias("raw_candidates"),
        F.col("n_dropped").alias("dropped_unverified"), F.coalesce("n_candidates", F.lit(0)).alias("candidates"),
        F.col("n_failed").alias("windows_parse_failed"),
    )


def audit_trace(windows: DataFrame, hints: DataFrame, candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """One event per window, then one summary event per document (``seq`` orders them)."""
    h = hints.groupBy("doc_id", "window_idx").agg(F.count(F.lit(1)).alias("hints"))
    c = candidates.groupBy("doc_id", "window_idx").agg(F.count(F.lit(1)).alias("candidates"))
    per_window = windows.join(h, ["doc_id", "window_idx"], "left").join(c, ["doc_id", "window_idx"], "left")
    events = per_window.select(
        "doc_id", F.col("window_idx").alias("seq"), F.lit("audit").alias("node"), "window_id",
        F.to_json(F.struct(
            F.coalesce("hints", F.lit(0)).alias("hints"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
            F.coalesce("hints", F.lit(0)).alias("hint_verdicts"),
        )).alias("detail"),
    )
    summary = stats.select(
        "doc_id", F.col("windows").alias("seq"), F.lit("audit_summary").alias("node"), F.lit(None).cast("string").alias("window_id"),
        F.to_json(F.struct("windows", "hints", "raw_candidates", "dropped_unverified", "candidates", "windows_parse_failed")).alias("detail"),
    )
    return events.unionByName(summary)


# ---- context of a candidate -----------------------------------------------------------------


def candidate_alternatives(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Lexicon alternatives of hits that start inside any occurrence, in order of first sight."""
    occ = candidates.select("doc_id", "cand_id", F.inline("occurrences")).select(
        "doc_id", "cand_id", F.col("char_start").alias("o_start"), F.col("char_end").alias("o_end")
    )
    inside = points_in_intervals(hits, occ, point="char_start", start="o_start", end="o_end")
    alts = inside.select(
        "doc_id", "cand_id", "char_start", F.negative("char_end").alias("e"), F.posexplode("alternatives").alias("p", "alt")
    )
    first = alts.groupBy("doc_id", "cand_id", "alt").agg(F.min(F.struct("char_start", "e", "p")).alias("at"))
    return first.groupBy("doc_id", "cand_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "alt"))), lambda s: s["alt"]).alias("alternatives")
    )


def candidate_context(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """The seven context fields an investigation reads."""
    alts = candidate_alternatives(candidates, hits)
    return candidates.join(alts, ["doc_id", "cand_id"], "left").select(
        "doc_id", "cand_id", "quote", "category", "reason", "sentence_text", "paragraph_text",
        F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"),
        F.size("occurrences").alias("occurrences_count"),
    )
