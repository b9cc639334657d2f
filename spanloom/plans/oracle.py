"""SQL building blocks for checking the text queries in another engine.

They restate each operator with word arrays, recursive queries and window functions, on
purpose in a different way than the Spark columns do. The regular expressions there know no
look-around and only ASCII word boundaries, so matching runs on a copy of the text in which
every non-ASCII letter or digit is replaced by ``x`` (same length, so offsets hold).
"""

from __future__ import annotations

from ..functions.text import WS_CHARS
from ..operators.parse import ABBREVIATIONS
from .inputs import LEXICON, RULES, WINDOW_TOKENS

WS = (
    "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
NOT_WS = WS.replace("[", "[^", 1)
CHARS = "'" + WS_CHARS + "'"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {CHARS})"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


def fold(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F\\pM\\pP\\pS\\pZ\\pC]', 'x', 'g')"


def english(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[^\\pL]', '', 'g'))"
    latin = f"length(regexp_replace({x}, '[^A-Za-z\\x{{212a}}\\x{{130}}]', '', 'g'))"
    return f"({letters} > 0 AND {latin} * 1.0 / {letters} >= 0.5)"


def alternation(terms) -> str:
    return "(?i)\\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + ")\\b"


def matches(name: str, source: str, text: str, pattern: str, keys: str = "doc_id") -> str:
    """CTEs giving (keys, n, m, char_start, char_end) of every match of ``pattern``."""
    return f"""
{name}_p AS (SELECT {keys}, string_split_regex({text}, '{pattern}') AS g, regexp_extract_all({text}, '{pattern}') AS m FROM {source}),
{name}_u AS (SELECT {keys}, g, m, unnest(range(1, len(m) + 1)) AS n FROM {name}_p),
{name} AS (SELECT {keys}, n, m[n] AS m,
  CAST(sum(length(g[n]) + length(m[n])) OVER (PARTITION BY {keys} ORDER BY n) - length(m[n]) AS INTEGER) AS char_start,
  CAST(sum(length(g[n]) + length(m[n])) OVER (PARTITION BY {keys} ORDER BY n) AS INTEGER) AS char_end FROM {name}_u)"""


RAW = "raw AS (SELECT doc_id, text FROM documents)"
# every document, with paragraphs separated by blank lines
PARAS = f"paras AS (SELECT doc_id, replace(text, {NL}, {NL} || {NL}) AS text FROM documents)"
DOCS = f"{PARAS}, docs AS (SELECT doc_id, text, {fold('text')} AS ft FROM paras WHERE {strip('text')} <> '' AND {english('text')})"

_BREAK = f"\\n{WS}*\\n"
_LINES = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_LIST = f"^(?:[-*•]|\\p{{Nd}}+[.)]|[a-zA-Z][.)]){WS}+{NOT_WS}"
_NUMBERED = f"^(?:\\p{{Nd}}+(?:\\.\\p{{Nd}}+)+\\.?|\\p{{Nd}}+\\.|[IVXLCDM]+\\.){WS}+{NOT_WS}"


def kind(t: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({t}, '{_LINES}'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""CASE WHEN NOT contains({t}, {NL}) AND {words(t)} <= 12 AND (regexp_matches({t}, '{_NUMBERED}')
 OR (NOT regexp_matches({t}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AND len(regexp_extract_all({t}, '\\p{{Lu}}')) >= 2)
 OR right({t}, 1) NOT IN ('.', '!', '?')) THEN 'heading'
 WHEN len(list_filter({lines}, lambda y: NOT regexp_matches(y, '{_LIST}'))) = 0 THEN 'list' ELSE 'paragraph' END"""


def blocks(source: str = "docs") -> str:
    return f"""
b_p AS (SELECT doc_id, string_split_regex(text, '{_BREAK}') AS g, regexp_extract_all(text, '{_BREAK}') AS m FROM {source}),
b_u AS (SELECT doc_id, g, m, unnest(range(1, len(g) + 1)) AS n FROM b_p),
b_r AS (SELECT doc_id, n, g[n] AS piece, coalesce(sum(length(g[n]) + coalesce(length(m[n]), 0)) OVER (PARTITION BY doc_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b_u),
b_t AS (SELECT doc_id, n, {strip('piece')} AS t, s + length(piece) - length(ltrim(piece, {CHARS})) AS s FROM b_r),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS block_idx, {kind('t')} AS kind, t AS text,
  CAST(s AS INTEGER) AS char_start, CAST(s + length(t) AS INTEGER) AS char_end FROM b_t WHERE t <> '')"""


_ABBR = ", ".join(f"'{a}'" for a in ABBREVIATIONS)

# sentences of every block (headings too), relative offsets turned absolute
SENTENCES = f"""
w_p AS (SELECT doc_id, block_idx, kind, text, char_start AS b0, regexp_extract_all(text, '{NOT_WS}+') AS w, regexp_extract_all(text, '{WS}+') AS s FROM blocks),
w_u AS (SELECT doc_id, block_idx, kind, b0, w, s, unnest(range(1, len(w) + 1)) AS n FROM w_p),
w_r AS (SELECT doc_id, block_idx, kind, n, w[n] AS word, w[n + 1] AS nxt, CASE WHEN n > 1 THEN w[n - 1] END AS p1, CASE WHEN n > 2 THEN w[n - 2] END AS p2,
  b0 + coalesce(sum(length(w[n]) + coalesce(length(s[n]), 0)) OVER (PARTITION BY doc_id, block_idx ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM w_u),
w_l AS (SELECT *, left(word, length(word) - 1) AS body FROM w_r),
w_c AS (SELECT *, lower(trim(CASE WHEN body <> '' THEN body ELSE p1 END, '.')) AS last1, lower(trim(CASE WHEN body <> '' THEN p1 ELSE p2 END, '.')) AS last2 FROM w_l),
w_b AS (SELECT *, CASE WHEN nxt IS NOT NULL AND right(word, 1) IN ('.', '!', '?', '…') AND regexp_matches(nxt, '^[A-Z"''(0-9]')
  AND NOT coalesce(last1 IN ({_ABBR}), false) AND NOT coalesce((last2 || ' ' || last1) IN ({_ABBR}), false) THEN 1 ELSE 0 END AS cut FROM w_c),
w_g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id, block_idx ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w_b),
all_sents AS (SELECT doc_id, block_idx, kind, g, CAST(min(ws) AS INTEGER) AS char_start, CAST(max(ws + length(word)) AS INTEGER) AS char_end, count(*) AS nw FROM w_g GROUP BY ALL),
sents AS (SELECT doc_id, block_idx, char_start, char_end, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, g) - 1 AS INTEGER) AS sentence_idx
  FROM all_sents WHERE kind <> 'heading')"""


def windows(budget: int = WINDOW_TOKENS, source: str = "docs") -> str:
    return f"""
bt AS (SELECT *, {words('text')} * 1.3::DOUBLE AS tokens FROM blocks),
over AS (SELECT s.doc_id, s.block_idx, s.kind, s.g, s.char_start, s.char_end, s.nw * 1.3::DOUBLE AS tok FROM all_sents s JOIN bt USING (doc_id, block_idx) WHERE bt.tokens > {budget}),
grp AS (SELECT doc_id, block_idx, kind, g, char_start, char_end, tok, 0 AS grp FROM over WHERE g = 0
  UNION ALL SELECT o.doc_id, o.block_idx, o.kind, o.g, o.char_start, o.char_end, CASE WHEN p.tok + o.tok > {budget} THEN o.tok ELSE p.tok + o.tok END,
  p.grp + CASE WHEN p.tok + o.tok > {budget} THEN 1 ELSE 0 END FROM grp p JOIN over o ON o.doc_id = p.doc_id AND o.block_idx = p.block_idx AND o.g = p.g + 1),
seg_u AS (SELECT doc_id, block_idx, kind, char_start, char_end FROM bt WHERE tokens <= {budget}
  UNION ALL SELECT doc_id, block_idx, kind, min(char_start), max(char_end) FROM grp GROUP BY doc_id, block_idx, kind, grp),
segs AS (SELECT u.doc_id, u.block_idx, u.kind, u.char_start, u.char_end, substr(d.text, u.char_start + 1, u.char_end - u.char_start) AS text,
  {words('substr(d.text, u.char_start + 1, u.char_end - u.char_start)')} * 1.3::DOUBLE AS tok,
  row_number() OVER (PARTITION BY u.doc_id ORDER BY u.char_start) - 1 AS i FROM seg_u u JOIN {source} d USING (doc_id)),
pk AS (SELECT doc_id, i, tok, 0 AS w, CASE WHEN kind = 'heading' THEN i ELSE -1 END AS h FROM segs WHERE i = 0
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN p.tok + s.tok > {budget} OR (s.kind = 'heading' AND p.tok >= {budget} * 0.5::DOUBLE) THEN s.tok ELSE p.tok + s.tok END,
  p.w + CASE WHEN p.tok + s.tok > {budget} OR (s.kind = 'heading' AND p.tok >= {budget} * 0.5::DOUBLE) THEN 1 ELSE 0 END,
  CASE WHEN s.kind = 'heading' THEN s.i ELSE p.h END FROM pk p JOIN segs s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
own AS (SELECT s.*, pk.w, pk.h FROM segs s JOIN pk USING (doc_id, i)),
tail AS (SELECT doc_id, w + 1 AS w, coalesce(max(i) FILTER (kind = 'paragraph'), max(i)) AS i FROM own GROUP BY doc_id, w),
lap AS (SELECT t.doc_id, t.w, s.char_start, s.char_end, s.text, s.block_idx FROM tail t JOIN segs s USING (doc_id, i)),
ow AS (SELECT doc_id, w, min(char_start) AS s0, max(char_end) AS e0, arg_max(h, i) AS h, string_agg(text, {NL} || {NL} ORDER BY i) AS body,
  string_agg(CAST(block_idx AS VARCHAR), ',' ORDER BY i) AS bi FROM own GROUP BY doc_id, w),
all_windows AS (SELECT ow.doc_id, CAST(ow.w AS INTEGER) AS window_idx, CASE WHEN l.text IS NULL THEN body ELSE l.text || {NL} || {NL} || body END AS text,
  CAST(coalesce(l.char_start, s0) AS INTEGER) AS char_start, CAST(e0 AS INTEGER) AS char_end, coalesce(hs.text, '') AS heading_path,
  CASE WHEN l.text IS NULL THEN bi ELSE CAST(l.block_idx AS VARCHAR) || ',' || bi END AS block_idxs, CAST(coalesce(l.char_end, s0) AS INTEGER) AS overlap_char_end
  FROM ow LEFT JOIN lap l ON l.doc_id = ow.doc_id AND l.w = ow.w LEFT JOIN segs hs ON hs.doc_id = ow.doc_id AND hs.i = ow.h),
capped AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_windows FROM all_windows GROUP BY doc_id),
windows AS (SELECT a.* FROM all_windows a SEMI JOIN capped USING (doc_id))"""


def lexicon() -> str:
    def esc(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(
        f"({i}, {esc(t)}, {esc(c)}, [{', '.join(esc(x) for x in a)}]::VARCHAR[], {esc(n)}, {esc(k)}, {esc(s)})"
        for i, (t, c, a, n, k, s) in enumerate(LEXICON)
    )
    return f"""lex_r(ord, term, category, alternatives, raw_note, condition, source) AS (VALUES {rows}),
lex AS (SELECT *, CASE WHEN condition = '' THEN raw_note WHEN raw_note = '' THEN 'condition: ' || condition ELSE 'condition: ' || condition || '; ' || raw_note END AS note FROM lex_r)"""


def hits(source: str = "docs") -> str:
    return f"""{lexicon()},{matches('hm', source, 'ft', alternation([e[0] for e in LEXICON]))},
hits AS (SELECT doc_id, char_start, char_end, l.term, l.category, l.alternatives, l.note, l.condition FROM hm JOIN lex l ON l.term = lower(m))"""


def rules() -> str:
    rows = ", ".join(f"({i}, '{r.word}', '{r.category}', '{r.replacement}')" for i, r in enumerate(RULES))
    return f"rules(pos, word, rule_category, replacement) AS (VALUES {rows})"


# candidates found by the rules in windows, verified against the text
CANDIDATES = f"""{rules()},
found AS (SELECT w.doc_id, w.window_idx, r.pos, r.rule_category AS category, 'contains: ' || r.word AS reason, w.char_start AS w0, w.char_end AS w1,
  regexp_extract({fold('w.text')}, '(?i)\\b' || r.word || '\\b') AS quote FROM windows w CROSS JOIN rules r),
placed AS (SELECT f.*, strpos(substr(d.text, w0 + 1), quote) AS p FROM found f JOIN docs d USING (doc_id) WHERE quote <> ''),
verified AS (SELECT doc_id, window_idx, pos, category, reason, quote, CASE WHEN p > 0 THEN CAST(w0 + p - 1 AS INTEGER) END AS char_start,
  CASE WHEN p > 0 THEN CAST(w0 + p - 1 + length(quote) AS INTEGER) END AS char_end, coalesce(w0 + p - 1 < w1 + 200 AND p > 0, false) AS accepted FROM placed),
deduped AS (SELECT * FROM verified WHERE accepted QUALIFY row_number() OVER (PARTITION BY doc_id, char_start, char_end ORDER BY window_idx, pos) = 1),
keyed AS (SELECT *, lower({strip(f"regexp_replace(quote, '{WS}+', ' ', 'g')")}) AS quote_key FROM deduped),
grouped AS (SELECT doc_id, quote_key, arg_min(struct_pack(window_idx := window_idx, pos := pos, category := category, reason := reason, quote := quote, char_start := char_start, char_end := char_end),
  char_start::BIGINT * 1000000 + window_idx * 1000 + pos) AS p, string_agg(char_start || '-' || char_end, ',' ORDER BY char_start, char_end) AS occurrences, count(*) AS n_occ,
  min(window_idx * 1000 + pos) AS first_seen FROM keyed GROUP BY doc_id, quote_key),
cands AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) - 1 AS INTEGER) AS cand_idx, quote_key, p.window_idx, p.pos, p.category, p.reason, p.quote,
  p.char_start, p.char_end, occurrences, n_occ FROM grouped)"""

HINTS = """
hiw AS (SELECT h.*, w.window_idx FROM hits h JOIN windows w ON w.doc_id = h.doc_id AND w.char_start <= h.char_start AND h.char_start < w.char_end),
tdc AS (SELECT doc_id, term, count(*) AS doc_count FROM hits GROUP BY doc_id, term),
hs AS (SELECT doc_id, window_idx, term, count(*) AS hit_count, min(char_start) AS first_start, arg_min(category, char_start) AS category, arg_min(alternatives[1:3], char_start) AS alternatives,
  arg_min(condition, char_start) AS condition, list(char_start || '-' || char_end ORDER BY char_start)[1:3] AS samples FROM hiw GROUP BY doc_id, window_idx, term),
hints AS (SELECT hs.*, tdc.doc_count, row_number() OVER (PARTITION BY doc_id, window_idx ORDER BY doc_count, first_start, term) AS rank FROM hs JOIN tdc USING (doc_id, term) QUALIFY rank <= 20)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip().strip(",") for c in ctes) + "\n"


AUDIT = (DOCS, blocks(), SENTENCES, windows(), CANDIDATES)
