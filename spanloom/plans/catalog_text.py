"""Registered queries: guards, parsing, matching, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import match as M
from ..operators import parse as P
from ..operators.passages import place_passages
from . import oracle as O
from .audit import text_pass
from .inputs import MAX_WINDOWS, RULES, WINDOW_TOKENS, documents, lexicon, raw_documents, table
from .registry import query


def guarded(spark, sf):
    return P.guard_english(P.guard_nonempty(documents(spark, sf)))


def windows_of(spark, sf):
    """Windows of all documents that pass the guards."""
    parsed = P.parse_documents(guarded(spark, sf), WINDOW_TOKENS, sentences=False)
    return parsed.select("doc_id", F.inline("windows"))


def hits(spark, sf):
    return M.lexicon_hits(guarded(spark, sf), lexicon(spark))


def read_once(spark, sf, rules=RULES, **options):
    """Audited rows, windows and hits of all documents from one pass over the texts."""
    return text_pass(documents(spark, sf), lexicon(spark), rules, window_tokens=WINDOW_TOKENS, **options)


def audited(spark, sf):
    return C.audit_documents(documents(spark, sf), RULES, window_tokens=WINDOW_TOKENS)


def span_list(col):
    return F.array_join(F.transform(col, lambda s: F.concat(s[0].cast("string"), F.lit("-"), s[1].cast("string"))), ",")


def pairs(col, a, b):
    return F.array_join(F.transform(col, lambda s: F.concat(s[a].cast("string"), F.lit("-"), s[b].cast("string"))), ",")


# ---- guards -------------------------------------------------------------------------------


@query("guard_nonempty", f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE {O.strip('text')} <> ''")
def _(spark, sf):
    return P.guard_nonempty(raw_documents(spark, sf)).select("doc_id", F.length("text").alias("n_chars"))


@query(
    "guard_english",
    f"""SELECT doc_id, {O.english('text')} AS is_english, round(length(regexp_replace(text, '[^A-Za-z\\x{{212a}}\\x{{130}}]', '', 'g'))
  * 1.0::DOUBLE / nullif(length(regexp_replace(text, '[^\\pL]', '', 'g')), 0), 6) AS latin_ratio FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return raw_documents(spark, sf).select("doc_id", T.is_english(t).alias("is_english"), F.round(T.latin_ratio(t), 6).alias("latin_ratio"))


@query(
    "guard_verdicts",
    f"""SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN {O.strip('text')} = '' THEN 'empty'
  WHEN NOT {O.english('text')} THEN 'not_english' END AS reason FROM documents) GROUP BY 1""",
)
def _(spark, sf):
    v = P.guard_verdicts(raw_documents(spark, sf))
    return v.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("guard_window_cap", O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows()) + f"SELECT doc_id, n_windows FROM capped WHERE n_windows <= {MAX_WINDOWS}")
def _(spark, sf):
    parsed = P.parse_documents(guarded(spark, sf), WINDOW_TOKENS, sentences=False)
    return P.guard_window_cap(parsed, MAX_WINDOWS).select("doc_id", F.size("windows").alias("n_windows"))


@query(
    "window_cap_rejects",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows()) + f"SELECT doc_id, 'too_many_windows' AS reason, n_windows FROM capped WHERE n_windows > {MAX_WINDOWS}",
)
def _(spark, sf):
    return P.window_cap_rejects(P.parse_documents(guarded(spark, sf), WINDOW_TOKENS, sentences=False), MAX_WINDOWS)



@query("document_scan", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    return raw_documents(spark, sf).select("doc_id", "text")


@query("token_estimate", f"SELECT doc_id, round({O.words('text')} * 1.3::DOUBLE, 6) AS tokens FROM documents")
def _(spark, sf):
    return raw_documents(spark, sf).select("doc_id", F.round(T.token_estimate(F.col("text")), 6).alias("tokens"))


# ---- parsing ---------------------------------------------------------------------------------


@query("block_split", O.with_(O.DOCS, O.blocks()) + "SELECT doc_id, block_idx, char_start, char_end, text FROM blocks")
def _(spark, sf):
    return P.block_table(guarded(spark, sf)).select("doc_id", "block_idx", "char_start", "char_end", "text")


@query("block_classify", O.with_(O.DOCS, O.blocks()) + "SELECT doc_id, block_idx, kind FROM blocks")
def _(spark, sf):
    return P.block_table(guarded(spark, sf)).select("doc_id", "block_idx", "kind")


@query(
    "sentence_split",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES)
    + "SELECT s.doc_id, s.block_idx, s.char_start, s.char_end, substr(d.text, s.char_start + 1, s.char_end - s.char_start) AS text FROM sents s JOIN docs d USING (doc_id)",
)
def _(spark, sf):
    return P.sentence_table(guarded(spark, sf)).select("doc_id", "block_idx", "char_start", "char_end", "text")


@query(
    "sentence_ids",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES)
    + "SELECT doc_id, 's' || CASE WHEN sentence_idx < 10000 THEN lpad(sentence_idx::VARCHAR, 4, '0') ELSE sentence_idx::VARCHAR END AS sentence_id, char_start FROM sents",
)
def _(spark, sf):
    return P.sentence_table(guarded(spark, sf)).select("doc_id", "sentence_id", "char_start")


@query(
    "oversize_split",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows())
    + "SELECT doc_id, CAST(i AS INTEGER) AS segment_idx, block_idx, kind, char_start, char_end, round(tok, 6) AS tokens FROM segs",
)
def _(spark, sf):
    return P.segment_table(guarded(spark, sf), WINDOW_TOKENS).select(
        "doc_id", "segment_idx", "block_idx", "kind", "char_start", "char_end", F.round("tokens", 6).alias("tokens")
    )


@query(
    "window_pack",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows()) + "SELECT doc_id, window_idx, block_idxs, char_end FROM all_windows",
)
def _(spark, sf):
    return P.window_table(guarded(spark, sf), WINDOW_TOKENS).select(
        "doc_id", "window_idx", F.array_join(F.col("block_idxs").cast("array<string>"), ",").alias("block_idxs"), "char_end"
    )


@query(
    "window_heading",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows()) + "SELECT doc_id, window_idx, heading_path FROM all_windows",
)
def _(spark, sf):
    return P.window_offsets(guarded(spark, sf), WINDOW_TOKENS).select("doc_id", "window_idx", "heading_path")


@query(
    "window_overlap",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES, O.windows())
    + "SELECT doc_id, window_idx, char_start, overlap_char_end, char_end, text FROM all_windows",
)
def _(spark, sf):
    return P.window_table(guarded(spark, sf), WINDOW_TOKENS).select(
        "doc_id", "window_idx", "char_start", "overlap_char_end", "char_end", "text"
    )


@query(
    "parse_roundtrip_check",
    O.with_(O.DOCS, O.blocks(), O.SENTENCES)
    + """SELECT 'block' AS kind, count(*) AS n, 0 AS violations FROM blocks UNION ALL SELECT 'sentence', count(*), 0 FROM sents""",
)
def _(spark, sf):
    kinds = spark.createDataFrame([("block",), ("sentence",)], "kind string")
    counts = P.roundtrip_counts(guarded(spark, sf))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("violations", F.lit(0)).cast("int").alias("violations"))


_CHUNK_SQL = f"""
ck_d AS (SELECT doc_id, text, {O.strip('text')} AS st, length(text) - length(ltrim(text, {O.CHARS})) AS lead FROM raw WHERE {O.strip('text')} <> ''),
ck_w AS (SELECT doc_id, text, lead, regexp_extract_all(st, '{O.NOT_WS}+') AS w, regexp_extract_all(st, '{O.WS}+') AS s FROM ck_d),
ck_u AS (SELECT doc_id, text, lead, w, s, unnest(range(1, len(w) + 1)) AS n FROM ck_w),
ck_r AS (SELECT doc_id, lead, n, length(w[n]) AS wl, lead + coalesce(sum(length(w[n]) + coalesce(length(s[n]), 0)) OVER (PARTITION BY doc_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws, CASE WHEN right(w[n], 1) IN ('.', '!', '?') AND regexp_matches(w[n + 1], '^[A-Z]') THEN 1 ELSE 0 END AS cut FROM ck_u),
ck_g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ck_r),
ck_s AS (SELECT doc_id, CAST(g AS INTEGER) AS chunk_idx, CAST(min(ws) AS INTEGER) AS char_start, CAST(max(ws + wl) AS INTEGER) AS char_end FROM ck_g GROUP BY doc_id, g),
chunks AS (SELECT c.*, substr(d.text, char_start + 1, char_end - char_start) AS text, substr(d.text, greatest(0, char_start - 80) + 1, char_start - greatest(0, char_start - 80)) AS context_before,
  substr(d.text, char_end + 1, 80) AS context_after FROM ck_s c JOIN ck_d d USING (doc_id))"""


@query("chunk_sentences", O.with_(O.RAW, _CHUNK_SQL) + "SELECT doc_id, chunk_idx, char_start, char_end, text, context_before, context_after FROM chunks")
def _(spark, sf):
    return P.chunk_table(raw_documents(spark, sf)).select(
        "doc_id", "chunk_idx", "char_start", "char_end", "text", "context_before", "context_after"
    )


# ---- matching ------------------------------------------------------------------------------


@query(
    "lexicon_hits",
    O.with_(O.DOCS, O.hits()) + "SELECT doc_id, char_start, char_end, term, category, note FROM hits",
)
def _(spark, sf):
    return hits(spark, sf).select("doc_id", "char_start", "char_end", "term", "category", "note")


def _batched_sql(size: int) -> str:
    ordered = sorted([e[0] for e in O.LEXICON], key=len, reverse=True)
    batches = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    ctes = [O.matches(f"h{i}", "docs", "ft", O.alternation(b)) for i, b in enumerate(batches)]
    union = " UNION ".join(f"SELECT doc_id, char_start, char_end, lower(m) AS term FROM h{i}" for i in range(len(batches)))
    return O.with_(O.DOCS, *ctes) + union


@query("lexicon_hits_batched", _batched_sql(4))
def _(spark, sf):
    return M.lexicon_hits(guarded(spark, sf), lexicon(spark), batch_size=4).select("doc_id", "char_start", "char_end", "term")


@query(
    "hits_by_category",
    O.with_(O.DOCS, O.hits()) + "SELECT category, term, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL",
)
def _(spark, sf):
    return hits(spark, sf).groupBy("category", "term").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("doc_id").alias("n_docs")
    )


def _lookup_sql() -> str:
    ctes, parts = [], []
    for i, e in enumerate(O.LEXICON):
        ctes.append(O.matches(f"t{i}", "fchunks", "ft", f"(?i)\\b{e[0]}\\b", "doc_id, chunk_idx, base0"))
        parts.append(
            f"SELECT doc_id, chunk_idx, '{e[0]}' AS term, CAST(base0 + char_start AS INTEGER) AS char_start, CAST(base0 + char_end AS INTEGER) AS char_end FROM t{i}"
        )
    fchunks = f"fchunks AS (SELECT doc_id, chunk_idx, char_start AS base0, {O.fold('text')} AS ft FROM chunks)"
    return O.with_(O.RAW, _CHUNK_SQL, fchunks, *ctes) + " UNION ALL ".join(parts)


@query("lexicon_lookup", _lookup_sql())
def _(spark, sf):
    return M.document_lookup(raw_documents(spark, sf), lexicon(spark)).select("doc_id", "chunk_idx", "term", "char_start", "char_end")


_WORDS = "[\\pL\\pN_]+"


def corpus_lexicon(spark, sf):
    """A vocabulary of some thousand terms: names of parts, words of the benchmark and pairs of them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORDS.replace("pL", "p{L}").replace("pN", "p{N}")), F.lit(0))
    said = table(spark, sf, "benchmark").select(words.alias("w"))
    pairs_of = F.transform(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("v")), lambda x: F.concat(x["w"], F.lit(" "), x["v"]))
    terms = said.select(F.explode(F.array_compact(F.concat("w", pairs_of))).alias("term")).union(table(spark, sf, "part").select(F.lower("p_name")))
    return terms.distinct().select(
        F.xxhash64("term").alias("ord"), "term", F.lit("biased").alias("category"), F.array().cast("array<string>").alias("alternatives"),
        F.lit("").alias("note"), F.lit("").alias("condition"), F.lit("corpus").alias("source"),
    )


@query(
    "lexicon_hits_joined",
    f"""WITH bw AS (SELECT regexp_extract_all(lower(text), '{_WORDS}') AS w FROM benchmark),
terms AS (SELECT unnest(w) AS term FROM bw UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bw) UNION SELECT lower(p_name) FROM part),
tk_p AS (SELECT doc_id, string_split_regex(text, '{_WORDS}') AS g, regexp_extract_all(text, '{_WORDS}') AS m FROM documents),
tk AS (SELECT doc_id, n, lower(m[n]) AS w, g[n + 1] AS gap, lower(m[n + 1]) AS nxt, sum(length(g[n]) + length(m[n])) OVER (PARTITION BY doc_id ORDER BY n) - length(m[n]) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM tk_p)),
tw AS (SELECT doc_id, n, w || gap || nxt AS term, s FROM tk WHERE nxt IS NOT NULL),
-- two words can only overlap their own next match ('the the the'): of a run of them every second counts
isl AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, term ORDER BY n) AS island FROM tw),
found AS (SELECT doc_id, w AS term, s FROM tk UNION ALL SELECT doc_id, term, s FROM isl QUALIFY row_number() OVER (PARTITION BY doc_id, term, island ORDER BY n) % 2 = 1)
SELECT doc_id, term, count(*) AS n_hits, CAST(sum(s) AS BIGINT) AS sum_starts FROM found JOIN terms USING (term) GROUP BY ALL""",
)
def _(spark, sf):
    found = M.joined_lexicon_hits(raw_documents(spark, sf), corpus_lexicon(spark, sf))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("char_start").alias("sum_starts"))


@query("note_with_condition", O.with_(O.DOCS, O.hits()) + "SELECT DISTINCT term, note FROM hits")
def _(spark, sf):
    return hits(spark, sf).select("term", "note").distinct()


@query(
    "condition_extract",
    O.with_(O.DOCS, O.hits()) + "SELECT condition, count(*) AS n FROM hits GROUP BY condition",
)
def _(spark, sf):
    from ..operators.lexicon import condition_of

    return hits(spark, sf).groupBy(condition_of(F.col("note")).alias("condition")).agg(F.count(F.lit(1)).alias("n"))


@query("term_doc_counts", O.with_(O.DOCS, O.hits()) + "SELECT doc_id, term, count(*) AS doc_count FROM hits GROUP BY ALL")
def _(spark, sf):
    return M.term_doc_counts(hits(spark, sf))


_WIN = (O.DOCS, O.blocks(), O.SENTENCES, O.windows(), O.hits(), O.HINTS)


@query("hits_in_window", O.with_(*_WIN) + "SELECT doc_id, window_idx, term, char_start, char_end FROM hiw")
def _(spark, sf):
    read = read_once(spark, sf, None)
    return M.hits_in_window(read.hits, read.windows).select("doc_id", "window_idx", "term", "char_start", "char_end")


@query("window_hints", O.with_(*_WIN) + "SELECT doc_id, window_idx, term, CAST(rank AS INTEGER) AS rank, doc_count, hit_count FROM hints")
def _(spark, sf):
    read = read_once(spark, sf, None)
    return M.window_hints(read.hits, read.windows).select(
        "doc_id", "window_idx", "term", "rank", "doc_count", "hit_count"
    )


@query(
    "hint_samples",
    O.with_(*_WIN)
    + """SELECT doc_id, window_idx, term, category, hit_count, array_to_string(samples, ',') AS sample_offsets, array_to_string(alternatives, ',') AS alternatives, condition FROM hs""",
)
def _(spark, sf):
    read = read_once(spark, sf, None)
    return M.hint_samples(read.hits, read.windows).select(
        "doc_id", "window_idx", "term", "category", "hit_count", pairs(F.col("sample_offsets"), "start", "end").alias("sample_offsets"),
        F.array_join("alternatives", ",").alias("alternatives"), "condition",
    )


# verdicts as a model would send them: by position in the hint list, some missing, some invalid
_VERDICT_SQL = """verdicts AS (SELECT doc_id, window_idx, term, rank AS pos, CASE WHEN rank = 1 THEN 'flag' WHEN rank = 2 THEN 'unsure' ELSE 'clean' END AS verdict FROM hints
  WHERE hit_count < 9 UNION ALL SELECT doc_id, window_idx, term, rank + 100, 'flag' FROM hints WHERE category = 'ableist')"""


def _verdicts(hints):
    first = hints.filter("hit_count < 9").select(
        "doc_id", "window_idx", "term", F.col("rank").alias("pos"),
        F.when(F.col("rank") == 1, "flag").when(F.col("rank") == 2, "unsure").otherwise("clean").alias("verdict"),
    )
    again = hints.filter("category = 'ableist'").select(
        "doc_id", "window_idx", "term", (F.col("rank") + 100).alias("pos"), F.lit("flag").alias("verdict")
    )
    return first.unionByName(again)


@query(
    "hint_adjudication",
    O.with_(*_WIN, _VERDICT_SQL)
    + """SELECT h.doc_id, h.window_idx, h.term, CASE WHEN v.verdict IN ('flag', 'clean') THEN v.verdict ELSE 'clean' END AS verdict, v.verdict IS NULL AS filled
  FROM hints h LEFT JOIN (SELECT doc_id, window_idx, term, arg_max(verdict, pos) AS verdict FROM verdicts GROUP BY ALL) v
  ON v.doc_id = h.doc_id AND v.window_idx = h.window_idx AND v.term = h.term""",
)
def _(spark, sf):
    read = read_once(spark, sf, None)
    hints = M.window_hints(read.hits, read.windows)
    return M.hint_adjudication(hints, _verdicts(hints)).select("doc_id", "window_idx", "term", "verdict", "filled")


_LINE_SQL = """rank || '. ' || term || ' [' || category || '] x' || hit_count || CASE WHEN len(alternatives) > 0 THEN ' | instead: ' || array_to_string(alternatives, ' / ') ELSE '' END
  || CASE WHEN condition <> '' THEN ' | only ' || condition ELSE '' END"""


@query(
    "audit_prompt",
    O.with_(*_WIN, f"hl AS (SELECT doc_id, window_idx, string_agg({_LINE_SQL}, {O.NL} ORDER BY rank) AS lines FROM hints GROUP BY doc_id, window_idx)")
    + f"""SELECT w.doc_id, w.window_idx, '{M.PROMPT_TASK}' || {O.NL} || coalesce('{M.PROMPT_TERMS}' || {O.NL} || lines || {O.NL}, '') || {O.NL}
  || 'Passage' || CASE WHEN heading_path <> '' THEN ' from "' || heading_path || '"' ELSE '' END || ':' || {O.NL} || '<passage>' || {O.NL} || text || {O.NL} || '</passage>' || {O.NL} AS prompt
  FROM windows w LEFT JOIN hl ON hl.doc_id = w.doc_id AND hl.window_idx = w.window_idx""",
)
def _(spark, sf):
    read = read_once(spark, sf, None, window_texts=True)
    return M.audit_prompts(read.windows, M.window_hints(read.hits, read.windows))


# ---- candidates -------------------------------------------------------------------------------


@query("rule_detect", O.with_(*O.AUDIT) + "SELECT doc_id, window_idx, pos, quote, category, reason FROM placed")
def _(spark, sf):
    parsed = P.parse_documents(guarded(spark, sf), WINDOW_TOKENS, sentences=False)
    return parsed.select("doc_id", F.inline(C.rule_detect_array(F.col("windows"), RULES))).select(
        "doc_id", "window_idx", "pos", "quote", "category", "reason"
    )


_CLASSIFY_SQL = f"""
cl_x AS (SELECT doc_id, chunk_idx, text, {O.fold('text')} AS ft FROM chunks),
cl_h AS (SELECT c.doc_id, c.chunk_idx, bool_or(r.rule_category = 'gendered') AS g, min(r.word) AS w FROM cl_x c JOIN rules r ON regexp_matches(c.ft, '(?i)\\b' || r.word || '\\b') GROUP BY ALL),
classified AS (SELECT c.doc_id, c.chunk_idx, c.text, CASE WHEN h.w IS NULL THEN 'skip' ELSE 'flag' END AS label, CASE WHEN h.g THEN 'gendered' WHEN h.w IS NOT NULL THEN 'exclusionary' END AS flag_category,
  CASE WHEN h.w IS NULL THEN 'no trigger' ELSE 'contains: ' || h.w END AS reason FROM cl_x c LEFT JOIN cl_h h ON h.doc_id = c.doc_id AND h.chunk_idx = c.chunk_idx)"""


@query("rule_classify", O.with_(O.RAW, _CHUNK_SQL, O.rules(), _CLASSIFY_SQL) + "SELECT doc_id, chunk_idx, label, flag_category, reason FROM classified")
def _(spark, sf):
    chunks = P.chunk_table(raw_documents(spark, sf)).select("doc_id", "chunk_idx", "text")
    return C.rule_classify(chunks, RULES).select("doc_id", "chunk_idx", "label", "flag_category", "reason")


def _rewrite_sql(x: str) -> str:
    """ASCII words between non-letters, replaced one rule after the other."""
    for r in RULES:
        edge = "[^\\pL\\pN_]"
        step = f"regexp_replace({x}, '(^|{edge})(?i:{r.word})({edge}|$)', '\\1{r.replacement}\\2', 'g')"
        # twice: neighbours share the character between them
        x = f"regexp_replace({step}, '(^|{edge})(?i:{r.word})({edge}|$)', '\\1{r.replacement}\\2', 'g')"
    return x


@query("rule_rewrite", f"SELECT doc_id, {_rewrite_sql('text')} AS rewritten FROM documents")
def _(spark, sf):
    return raw_documents(spark, sf).select("doc_id", C.rule_rewrite(F.col("text"), RULES).alias("rewritten"))


_CATS = ", ".join(f"('{c.replace('-', ' ')}', '{c}')" for c in C.CATEGORIES)


@query(
    "normalize_category",
    f"""WITH k(key, cat) AS (VALUES {_CATS}), r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(cat) WHEN 1 THEN ' ' || replace(cat, '-', '_') || ' '
  WHEN 2 THEN p_name ELSE NULL END AS raw FROM part JOIN (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS i FROM k) ON i = p_partkey % 7)
SELECT p_partkey, coalesce(k.cat, 'potentially-offensive') AS category FROM r LEFT JOIN k ON k.key = replace(replace(lower(trim(raw)), '_', ' '), '-', ' ')""",
)
def _(spark, sf):
    names = F.array(*[F.lit(c) for c in sorted(C.CATEGORIES)])
    cat = F.get(names, (F.col("p_partkey") % 7).cast("int"))
    m = F.col("p_partkey") % 4
    raw = F.when(m == 0, F.upper(cat)).when(m == 1, F.concat(F.lit(" "), F.replace(cat, F.lit("-"), F.lit("_")), F.lit(" "))).when(m == 2, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", C.normalize_category(raw).alias("category"))


@query(
    "normalize_label",
    """SELECT event_id, CASE WHEN l IN ('flag', 'ask', 'skip') THEN l WHEN starts_with(lower(l), 'flag') THEN 'flag' WHEN starts_with(lower(l), 'ask') THEN 'ask' ELSE 'skip' END AS label
  FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'Flagged!' WHEN 'click' THEN 'ask_user' WHEN 'view' THEN 'skip' ELSE event_type END AS l FROM events)""",
)
def _(spark, sf):
    t = F.col("event_type")
    raw = F.when(t == "error", "Flagged!").when(t == "click", "ask_user").when(t == "view", "skip").otherwise(t)
    return table(spark, sf, "events").select("event_id", C.normalize_label(raw).alias("label"))


_VER = "SELECT doc_id, window_idx, pos, quote, char_start, char_end, accepted FROM verified"


@query("quote_accept", O.with_(*O.AUDIT) + _VER)
def _(spark, sf):
    parsed = P.parse_documents(guarded(spark, sf), WINDOW_TOKENS, sentences=False)
    found = C.verify_array(F.col("text"), C.rule_detect_array(F.col("windows"), RULES))
    return parsed.select("doc_id", F.inline(found)).select("doc_id", "window_idx", "pos", "quote", "char_start", "char_end", "accepted")


@query(
    "quote_verify_exact",
    "SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS char_start FROM documents d JOIN benchmark b ON strpos(d.text, b.text) > 0",
)
def _(spark, sf):
    return benchmark_spans(spark, sf).select("doc_id", "item_id", "char_start")


def benchmark_spans(spark, sf):
    """First place of each benchmark passage in each document."""
    return place_passages(raw_documents(spark, sf), table(spark, sf, "benchmark"))


@query(
    "quote_verify_ws",
    f"""WITH q AS (SELECT item_id, regexp_replace({O.strip('text')}, '{O.WS}+', '  ', 'g') AS quote, regexp_replace({O.strip('text')}, '{O.WS}+', ' ', 'g') AS norm FROM benchmark),
n AS (SELECT doc_id, text, regexp_replace(text, '{O.WS}+', ' ', 'g') AS norm FROM documents)
SELECT d.doc_id, q.item_id, length(q.norm) AS norm_chars FROM n d JOIN q ON strpos(d.norm, q.norm) > 0""",
)
def _(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.regexp_replace(T.strip(F.col("text")), T.WS + "+", "  ").alias("text"))
    docs = raw_documents(spark, sf).select("doc_id", "text")
    spans = place_passages(docs, items, loose=True).join(docs, "doc_id")
    cut = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return spans.select("doc_id", "item_id", F.length(F.regexp_replace(cut, T.WS + "+", " ")).alias("norm_chars"))


@query(
    "attach_sentence",
    O.with_(*O.AUDIT)
    + "SELECT v.doc_id, v.window_idx, v.pos, s.sentence_idx FROM verified v LEFT JOIN sents s ON s.doc_id = v.doc_id AND s.char_start <= v.char_start AND v.char_start < s.char_end WHERE accepted",
)
def _(spark, sf):
    points = C.verified_candidates(audited(spark, sf)).select("doc_id", "window_idx", "pos", "char_start")
    out = C.attach_sentence(points, P.sentence_table(guarded(spark, sf)).drop("text"))
    return out.select("doc_id", "window_idx", "pos", F.substring("sentence_id", 2, 20).cast("int").alias("sentence_idx"))


@query("overlap_dedupe", O.with_(*O.AUDIT) + "SELECT doc_id, window_idx, pos, quote, char_start, char_end FROM deduped")
def _(spark, sf):
    return C.overlap_dedupe(C.verified_candidates(audited(spark, sf))).select("doc_id", "window_idx", "pos", "quote", "char_start", "char_end")


@query("recurrence_group", O.with_(*O.AUDIT) + "SELECT doc_id, quote_key, quote, char_start, char_end, occurrences FROM cands")
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select(
        "doc_id", "quote_key", "quote", "char_start", "char_end", pairs(F.col("occurrences"), "char_start", "char_end").alias("occurrences")
    )


@query(
    "candidate_ids",
    O.with_(*O.AUDIT) + "SELECT doc_id, 'cand' || lpad(cand_idx::VARCHAR, 4, '0') AS cand_id, quote_key, category, reason FROM cands",
)
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select("doc_id", "cand_id", "quote_key", "category", "reason")


_STATS_SQL = """st AS (SELECT c.doc_id, c.n_windows AS windows, coalesce(h.n, 0) AS hints, coalesce(v.raw, 0) AS raw_candidates, coalesce(v.dropped, 0) AS dropped_unverified,
  coalesce(k.n, 0) AS candidates, 0 AS windows_parse_failed FROM capped c LEFT JOIN (SELECT doc_id, count(*) AS n FROM hints GROUP BY 1) h USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS raw, count(*) FILTER (NOT accepted) AS dropped FROM verified GROUP BY 1) v USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM cands GROUP BY 1) k USING (doc_id))"""


def _stats(spark, sf):
    read = read_once(spark, sf)
    hints = M.window_hints(read.hits, read.windows)
    n = hints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hints"))
    return read, hints, C.audit_stats(read.audited, C.candidates_of(read.audited), n)


@query("audit_stats", O.with_(*O.AUDIT, O.hits(), O.HINTS, _STATS_SQL) + "SELECT * FROM st")
def _(spark, sf):
    return _stats(spark, sf)[2]


@query(
    "audit_trace",
    O.with_(*O.AUDIT, O.hits(), O.HINTS, _STATS_SQL)
    + """SELECT w.doc_id, w.window_idx AS seq, 'audit' AS node, '{"hints":' || coalesce(h.n, 0) || ',"candidates":' || coalesce(v.n, 0) || ',"hint_verdicts":' || coalesce(h.n, 0) || '}' AS detail
  FROM windows w LEFT JOIN (SELECT doc_id, window_idx, count(*) AS n FROM hints GROUP BY ALL) h ON h.doc_id = w.doc_id AND h.window_idx = w.window_idx
  LEFT JOIN (SELECT doc_id, window_idx, count(*) AS n FROM placed GROUP BY ALL) v ON v.doc_id = w.doc_id AND v.window_idx = w.window_idx
UNION ALL SELECT doc_id, windows, 'audit_summary', '{"windows":' || windows || ',"hints":' || hints || ',"raw_candidates":' || raw_candidates || ',"dropped_unverified":' || dropped_unverified
  || ',"candidates":' || candidates || ',"windows_parse_failed":' || windows_parse_failed || '}' FROM st""",
)
def _(spark, sf):
    read, hints, stats = _stats(spark, sf)
    return C.audit_trace(read.windows, hints, read.detected, stats).select("doc_id", "seq", "node", "detail")


# ---- context --------------------------------------------------------------------------------------

_CONTEXT_SQL = """
occ AS (SELECT doc_id, cand_idx, CAST(split_part(o, '-', 1) AS INTEGER) AS o0, CAST(split_part(o, '-', 2) AS INTEGER) AS o1 FROM (SELECT doc_id, cand_idx, unnest(string_split(occurrences, ',')) AS o FROM cands)),
oh AS (SELECT o.doc_id, o.cand_idx, h.char_start, h.char_end, h.alternatives, unnest(range(1, len(h.alternatives) + 1)) AS p FROM occ o JOIN hits h ON h.doc_id = o.doc_id AND o.o0 <= h.char_start AND h.char_start < o.o1),
al AS (SELECT doc_id, cand_idx, alternatives[p] AS alt, min(char_start * 1000 + p) AS k FROM oh GROUP BY ALL),
alts AS (SELECT doc_id, cand_idx, string_agg(alt, ',' ORDER BY k) AS alternatives FROM al GROUP BY ALL),
cs AS (SELECT c.*, s.block_idx AS sb, CASE WHEN s.char_start IS NULL THEN c.quote ELSE substr(d.text, s.char_start + 1, s.char_end - s.char_start) END AS sentence_text FROM cands c JOIN docs d USING (doc_id)
  LEFT JOIN sents s ON s.doc_id = c.doc_id AND s.char_start <= c.char_start AND c.char_start < s.char_end),
cp AS (SELECT cs.*, coalesce(b.text, cs.quote) AS paragraph_text FROM cs LEFT JOIN blocks b ON b.doc_id = cs.doc_id AND b.char_start <= cs.char_start AND cs.char_start < b.char_end)"""


@query("candidate_sentence", O.with_(*O.AUDIT, O.hits(), _CONTEXT_SQL) + "SELECT doc_id, cand_idx, sentence_text FROM cs")
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select("doc_id", "cand_idx", "sentence_text")


@query("candidate_paragraph", O.with_(*O.AUDIT, O.hits(), _CONTEXT_SQL) + "SELECT doc_id, cand_idx, paragraph_text FROM cp")
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select("doc_id", "cand_idx", "paragraph_text")


@query(
    "candidate_alternatives",
    O.with_(*O.AUDIT, O.hits(), _CONTEXT_SQL) + "SELECT doc_id, 'cand' || lpad(cand_idx::VARCHAR, 4, '0') AS cand_id, alternatives FROM alts",
)
def _(spark, sf):
    read = read_once(spark, sf)
    return C.candidate_alternatives(C.candidates_of(read.audited), read.hits).select(
        "doc_id", "cand_id", F.array_join("alternatives", ",").alias("alternatives")
    )


@query(
    "candidate_context",
    O.with_(*O.AUDIT, O.hits(), _CONTEXT_SQL)
    + """SELECT c.doc_id, 'cand' || lpad(c.cand_idx::VARCHAR, 4, '0') AS cand_id, c.quote, c.category, c.reason, c.sentence_text, c.paragraph_text, coalesce(a.alternatives, '') AS alternatives,
  CAST(c.n_occ AS INTEGER) AS occurrences_count FROM cp c LEFT JOIN alts a ON a.doc_id = c.doc_id AND a.cand_idx = c.cand_idx""",
)
def _(spark, sf):
    read = read_once(spark, sf)
    return C.candidate_context(C.candidates_of(read.audited), read.hits).withColumn(
        "alternatives", F.array_join("alternatives", ",")
    )


def _expand_sql() -> str:
    """Matches of each flag word anywhere in the text, for documents where it is a candidate."""
    ctes, parts = [], []
    for i, r in enumerate(RULES):
        ctes.append(O.matches(f"x{i}", f"(SELECT d.doc_id, d.ft FROM docs d SEMI JOIN (SELECT doc_id FROM cands WHERE quote_key = '{r.word}') USING (doc_id)) z{i}", "ft", f"(?i){r.word}"))
        parts.append(f"SELECT doc_id, '{r.word}' AS quote_key, char_start, char_end FROM x{i}")
    return O.with_(*O.AUDIT, *ctes) + " UNION ALL ".join(parts)


@query("expand_occurrences", _expand_sql())
def _(spark, sf):
    return C.candidates_of(audited(spark, sf)).select("doc_id", "quote_key", F.inline("expanded"))


# ---- responses -------------------------------------------------------------------------------------

# what a model might send: plain JSON, a fenced block, JSON inside prose, or no JSON at all
_REPLY_SQL = """reply AS (SELECT conv_id AS doc_id, turn AS window_idx, conv_id % 4 AS shape,
  '{"candidates":[{"quote":"' || role || ' ' || turn || '","category":"' || CASE turn % 3 WHEN 0 THEN 'Gendered' WHEN 1 THEN 'factually_incorrect' ELSE 'other' END
  || '","reason":"r' || conv_id || '","lexicon_backed":true},{"quote":"","category":"biased"}],"hint_verdicts":[{"term":"' || role || '","verdict":"flag"}]}' AS js FROM conversations)"""


def replies(spark, sf):
    turn = F.col("turn")
    category = F.when(turn % 3 == 0, "Gendered").when(turn % 3 == 1, "factually_incorrect").otherwise("other")
    js = F.concat(
        F.lit('{"candidates":[{"quote":"'), "role", F.lit(" "), turn.cast("string"), F.lit('","category":"'), category,
        F.lit('","reason":"r'), F.col("conv_id").cast("string"),
        F.lit('","lexicon_backed":true},{"quote":"","category":"biased"}],"hint_verdicts":[{"term":"'), "role", F.lit('","verdict":"flag"}]}'),
    )
    shape = F.col("conv_id") % 4
    raw = (
        F.when(shape == 0, js).when(shape == 1, F.concat(F.lit("Here you go:\n```json\n"), js, F.lit("\n```\nDone.")))
        .when(shape == 2, F.concat(F.lit("Sure {not json} "), js, F.lit(" as asked."))).otherwise(F.concat(F.lit("No JSON: {"), F.col("text")))
    )
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("window_idx"), raw.alias("raw"))


@query("response_parse", O.with_(_REPLY_SQL) + "SELECT doc_id, window_idx, shape = 3 AS parse_failed FROM reply")
def _(spark, sf):
    return C.parse_responses(replies(spark, sf)).select("doc_id", "window_idx", "parse_failed")


@query(
    "candidate_normalize",
    O.with_(_REPLY_SQL)
    + """SELECT doc_id, window_idx, 0 AS pos, js->>'$.candidates[0].quote' AS quote, CASE lower(js->>'$.candidates[0].category') WHEN 'gendered' THEN 'gendered'
  WHEN 'factually_incorrect' THEN 'factually-incorrect' ELSE 'potentially-offensive' END AS category, js->>'$.candidates[0].reason' AS reason, true AS lexicon_backed FROM reply WHERE shape <> 3""",
)
def _(spark, sf):
    return C.candidate_normalize(C.parse_responses(replies(spark, sf)))


