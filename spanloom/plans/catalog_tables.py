"""Registered queries: sources, lexicon construction, retrieval, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, hash_embed
from ..operators import lexicon as L
from ..operators import retrieval as G
from ..operators import telemetry as M
from ..sources import corpus as S
from . import oracle as O
from .inputs import evidence_vectors, raw_documents, table
from .registry import query

# ---- corpus -------------------------------------------------------------------------------

_CORPUS_SQL = """corpus AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source, 'D' || CAST(doc_id AS VARCHAR) AS doc_id, left(text, 300) AS title, 'abstract' AS content_type,
  CASE WHEN doc_id % 7 = 3 THEN '  ' ELSE text END AS chunk_text, lang AS subject, CAST(1995 + n_chars % 32 AS VARCHAR) AS year,
  CASE WHEN lang = 'en' THEN 'T' ELSE 'F' END AS peerreviewed, 'https://example.org/' || CAST(doc_id AS VARCHAR) AS url, 'public-domain' AS license FROM documents)"""


def corpus_rows(spark, sf):
    d = S.spread(table(spark, sf, "documents"))
    key = F.col("doc_id").cast("string")
    return d.select(
        key.alias("chunk_id"), "source", F.concat(F.lit("D"), key).alias("doc_id"), F.left("text", F.lit(300)).alias("title"),
        F.lit("abstract").alias("content_type"), F.when(F.col("doc_id") % 7 == 3, "  ").otherwise(F.col("text")).alias("chunk_text"),
        F.col("lang").alias("subject"), (1995 + F.col("n_chars") % 32).cast("string").alias("year"),
        F.when(F.col("lang") == "en", "T").otherwise("F").alias("peerreviewed"), F.concat(F.lit("https://example.org/"), key).alias("url"),
        F.lit("public-domain").alias("license"),
    )


@query("corpus_scan", O.with_(_CORPUS_SQL) + f"SELECT chunk_id, doc_id, year, url FROM corpus WHERE {O.strip('chunk_text')} <> ''")
def _(spark, sf):
    return S.corpus_scan(corpus_rows(spark, sf)).select("chunk_id", "doc_id", "year", "url")


@query(
    "corpus_sample",
    O.with_(_CORPUS_SQL) + f"SELECT chunk_id, doc_id FROM corpus WHERE {O.strip('chunk_text')} <> '' ORDER BY CAST(chunk_id AS BIGINT) LIMIT 50",
)
def _(spark, sf):
    rows = S.corpus_scan(corpus_rows(spark, sf)).withColumn("file_order", F.col("chunk_id").cast("bigint"))
    return S.corpus_sample(rows, 50, "file_order").select("chunk_id", "doc_id")


@query("text_truncate", "SELECT doc_id, left(text, 8000) AS text FROM documents")
def _(spark, sf):
    return raw_documents(spark, sf).select("doc_id", S.text_truncate(F.col("text")).alias("text"))


@query(
    "corpus_project",
    O.with_(_CORPUS_SQL)
    + f"""SELECT 'eric_' || chunk_id AS id, chunk_text AS text, source, doc_id, left(title, 200) AS title, year, url FROM corpus WHERE {O.strip('chunk_text')} <> ''""",
)
def _(spark, sf):
    return S.corpus_project(S.corpus_scan(corpus_rows(spark, sf)))


_API_SQL = """api AS (SELECT doc_id % 5 AS query_idx, doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'D' || CAST(doc_id - doc_id % 3 AS VARCHAR) END AS id,
  CASE WHEN lang = 'fr' THEN NULL ELSE left(text, 60) END AS title, [lang, source] AS description, n_chars AS publicationdateyear, 'T' AS peerreviewed FROM documents)"""


def api_docs(spark, sf):
    d = S.spread(table(spark, sf, "documents"))
    shared = F.concat(F.lit("D"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string"))
    return d.select(
        (F.col("doc_id") % 5).alias("query_idx"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 11 != 0, shared).alias("id"),
        F.when(F.col("lang") != "fr", F.left("text", F.lit(60))).alias("title"), F.array("lang", "source").alias("description"),
        F.col("n_chars").alias("publicationdateyear"), F.lit("T").alias("peerreviewed"),
    )


_NORM_SQL = """norm AS (SELECT query_idx, pos, 'eric' AS source, coalesce(id, '') AS doc_id, coalesce(title, '') AS title, 'abstract' AS content_type, array_to_string(description, '; ') AS chunk_text,
  '' AS subject, CAST(publicationdateyear AS VARCHAR) AS year, peerreviewed, CASE WHEN id IS NULL THEN '' ELSE 'https://eric.ed.gov/?id=' || id END AS url, 'public-domain' AS license FROM api)"""


@query("api_doc_normalize", O.with_(_API_SQL, _NORM_SQL) + "SELECT * FROM norm")
def _(spark, sf):
    return S.api_doc_normalize(api_docs(spark, sf))


@query(
    "corpus_append_dedup",
    O.with_(_CORPUS_SQL, _API_SQL, _NORM_SQL)
    + """SELECT doc_id, query_idx, pos, CAST((SELECT max(try_cast(chunk_id AS BIGINT)) FROM corpus WHERE subject <> 'en') + row_number() OVER (ORDER BY query_idx, pos) AS VARCHAR) AS chunk_id
  FROM (SELECT * FROM norm WHERE doc_id <> '' AND doc_id NOT IN (SELECT doc_id FROM corpus WHERE subject <> 'en') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_idx, pos) = 1)""",
)
def _(spark, sf):
    existing = corpus_rows(spark, sf).filter("subject <> 'en'")
    out = S.corpus_append_dedup(existing, S.api_doc_normalize(api_docs(spark, sf)), width=100)
    return out.select("doc_id", "query_idx", "pos", "chunk_id")


@query(
    "query_list_scan",
    f"""SELECT event_id, line AS query FROM (SELECT event_id, trim(CASE event_type WHEN 'view' THEN '# ' || props WHEN 'error' THEN '   ' ELSE ' ' || event_type || ' ' || user_id || '  ' END) AS line FROM events)
  WHERE line <> '' AND NOT starts_with(line, '#')""",
)
def _(spark, sf):
    t = F.col("event_type")
    line = F.when(t == "view", F.concat(F.lit("# "), "props")).when(t == "error", "   ").otherwise(
        F.concat(F.lit(" "), t, F.lit(" "), F.col("user_id").cast("string"), F.lit("  "))
    )
    return S.query_list(table(spark, sf, "events").select("event_id", line.alias("value"))).select("event_id", "query")


_GOLD_ROWS = """WITH g AS (SELECT l.doc_id, d.text, CASE (l.doc_id + quality) % 6 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Biased' WHEN 2 THEN 'Potentially Offensive' WHEN 3 THEN 'Factually Incorrect' WHEN 4 THEN 'Outdated' ELSE 'Unknown' END AS raw,
  upper(lang) AS language FROM labels l JOIN documents d USING (doc_id))
"""


@query("gold_sentence_scan", _GOLD_ROWS + "SELECT doc_id, raw <> 'Correct' AS expected_flag, CASE WHEN raw <> 'Correct' THEN replace(lower(raw), ' ', '-') END AS expected_category, language FROM g WHERE raw <> 'Unknown' AND language = 'EN'")
def _(spark, sf):
    return S.gold_sentences(_gold_rows(spark, sf), "EN").select("doc_id", "expected_flag", "expected_category", "language")


def _gold_rows(spark, sf):
    i = (F.col("doc_id") + F.col("quality")) % 6
    names = ["Correct", "Biased", "Potentially Offensive", "Factually Incorrect", "Outdated", "Unknown"]
    raw = F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    joined = table(spark, sf, "labels").join(raw_docs(spark, sf), "doc_id")
    return joined.select("doc_id", F.col("text").alias("sentence"), raw.alias("expected_label_raw"), F.upper("lang").alias("language"))


def raw_docs(spark, sf):
    return S.spread(table(spark, sf, "documents"))


@query(
    "gold_jsonl_scan",
    f"""SELECT doc_id AS row_idx, upper(lang) AS lang FROM documents WHERE lang = 'en' AND doc_id NOT IN ({', '.join(map(str, S.EXEMPLAR_ROWS))})""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.upper("lang").alias("lang"))
    return S.gold_jsonl(rows)


@query(
    "gold_span_scan",
    """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS gold_idx, turn * 10 AS char_start, turn * 10 + length(text) AS char_end, role AS label FROM conversations""",
)
def _(spark, sf):
    span = F.struct((F.col("turn") * 10).alias("char_start"), (F.col("turn") * 10 + F.length("text")).alias("char_end"), F.col("role").alias("label"))
    files = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", span.alias("s")))), lambda x: x["s"]).alias("spans")
    )
    return S.gold_span_rows(files)


# ---- lexicon sources, derived from part, supplier and nation ----------------------------------------

_CURATED_SQL = """cur AS (SELECT p_partkey, ' ' || upper(p_name) || ' ' AS term, CASE p_partkey % 3 WHEN 0 THEN 'gendered' WHEN 1 THEN 'outdated' ELSE 'ableist' END AS category,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand || '| ' || p_type || ' ||' END AS alternatives, CASE WHEN p_size % 2 = 0 THEN ' size ' || p_size ELSE NULL END AS note, CASE WHEN p_size % 5 = 0 THEN 'if ' || p_type END AS condition,
  'https://example.org/' || p_brand AS source_url FROM part)"""


def curated_rows(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("term"),
        F.when(k % 3 == 0, "gendered").when(k % 3 == 1, "outdated").otherwise("ableist").alias("category"),
        F.when(size % 4 == 0, "").otherwise(F.concat("p_brand", F.lit("| "), "p_type", F.lit(" ||"))).alias("alternatives"),
        F.when(size % 2 == 0, F.concat(F.lit(" size "), size.cast("string"))).alias("note"),
        F.when(size % 5 == 0, F.concat(F.lit("if "), "p_type")).alias("condition"), F.concat(F.lit("https://example.org/"), "p_brand").alias("source_url"),
    )


def _flat(entries, *keys):
    return entries.select(*keys, "term", "category", F.array_join("alternatives", ";").alias("alternatives"), "note", "condition", "source")


@query(
    "curated_csv_scan",
    O.with_(_CURATED_SQL)
    + """SELECT p_partkey, lower(trim(term)) AS term, category, array_to_string(list_filter(list_transform(string_split(alternatives, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS alternatives,
  trim(coalesce(note, '')) AS note, coalesce(condition, '') AS condition, source_url AS source FROM cur""",
)
def _(spark, sf):
    return _flat(L.curated_entries(curated_rows(spark, sf), keep=["p_partkey"]), "p_partkey")


@query(
    "lexicon_normalize",
    O.with_(_CURATED_SQL) + "SELECT p_partkey, lower(trim(term)) AS term FROM cur WHERE trim(term) <> ''",
)
def _(spark, sf):
    return L.lexicon_normalize(curated_rows(spark, sf)).select("p_partkey", "term")


@query(
    "lexicon_scan",
    "SELECT p_brand, p_name AS term, p_type AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord FROM part",
)
def _(spark, sf):
    entry = F.struct(
        F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.array("p_brand").alias("alternatives"),
        F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("condition"), F.col("p_brand").alias("source"),
    )
    files = table(spark, sf, "part").groupBy("p_brand").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]).alias("entries")
    )
    return S.lexicon_scan(files, keep=("p_brand",)).select("p_brand", "term", "category", "ord")


_LEGACY_CAT = "CASE p_size % 3 WHEN 0 THEN 'culturally-insensitive' WHEN 1 THEN 'ableist-loaded' ELSE 'gendered' END"


@query(
    "legacy_json_scan",
    f"""SELECT p_partkey, lower(trim(p_name)) AS term, CASE c WHEN 'culturally-insensitive' THEN 'potentially-offensive' WHEN 'ableist-loaded' THEN 'ableist' ELSE c END AS category, p_brand AS alternatives, '' AS note,
  CASE WHEN c = 'ableist-loaded' THEN '{L.LEGACY_CONDITIONS['ableist-loaded']}' ELSE '' END AS condition, 'legacy' AS source FROM (SELECT *, {_LEGACY_CAT} AS c FROM part)""",
)
def _(spark, sf):
    m = F.col("p_size") % 3
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("term"), F.when(m == 0, "culturally-insensitive").when(m == 1, "ableist-loaded").otherwise("gendered").alias("category"),
        F.array("p_brand").alias("alternatives"), F.lit(None).cast("string").alias("note"),
    )
    return _flat(L.legacy_entries(rows, "legacy", keep=["p_partkey"]), "p_partkey")


_RULE_SQL = """rl AS (SELECT p_partkey, p_partkey % 3 AS shape, p_name AS n1, lower(p_type) || CASE WHEN p_size % 6 = 0 THEN ' *' ELSE '' END AS n2, p_brand, p_size FROM part),
rt AS (SELECT *, unnest(CASE shape WHEN 0 THEN [n1, n2] WHEN 1 THEN [n1] ELSE [n2, n1] END) AS t FROM rl)"""


@query(
    "rule_flatten",
    O.with_(_RULE_SQL)
    + """SELECT p_partkey, lower(trim(t)) AS term, 'gendered' AS category, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ';other' END AS alternatives,
  trim(CASE WHEN p_size % 4 = 0 THEN 'note ' || p_size ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' (see also: ' || p_brand || ')' ELSE '' END) AS note,
  CASE WHEN p_size % 5 = 0 THEN 'when ' || n1 ELSE '' END AS condition, 'rules @ 1' AS source FROM rt WHERE NOT contains(t, '*') AND trim(t) <> ''""",
)
def _(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    n2 = F.concat(F.lower("p_type"), F.when(size % 6 == 0, " *").otherwise(""))
    shape = F.col("p_partkey") % 3
    bad = (
        F.when(shape == 0, F.to_json(F.create_map("p_name", F.lit("m"), n2, F.lit("f"))))
        .when(shape == 1, F.to_json(F.struct("p_name"))).otherwise(F.to_json(F.array(n2, "p_name")))
    )
    good = F.when(size % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise(F.to_json(F.array("p_brand", F.lit("other"))))
    bad = F.when(shape == 1, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(bad)
    extra = F.concat(
        F.when(size % 4 == 0, F.concat(F.lit(',"note":"note '), size.cast("string"), F.lit('"'))).otherwise(""),
        F.when(size % 3 == 0, F.concat(F.lit(',"source":"'), "p_brand", F.lit('"'))).otherwise(""),
        F.when(size % 5 == 0, F.concat(F.lit(',"condition":"when '), "p_name", F.lit('"'))).otherwise(""),
    )
    line = F.concat(F.lit('{"inconsiderate":'), bad, F.lit(',"considerate":'), good, extra, F.lit("}"))
    rules = S.rule_scan(p.select("p_partkey", line.alias("value")), keep=("p_partkey",))
    rules = rules.withColumn("category", F.lit("gendered")).withColumn("source_tag", F.lit("rules @ 1"))
    return _flat(L.rule_entries(rules, keep=["p_partkey"]), "p_partkey")


_TIER_SQL = """ti AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Blackhat-Whitehat' WHEN 1 THEN 'sanity-check' WHEN 2 THEN 'master-slave' ELSE p_name END AS slug, p_size % 4 AS tier,
  CASE p_size % 3 WHEN 0 THEN ['None', p_brand || '*', ' Consider ' || p_type] WHEN 1 THEN ['Do not use ' || p_type, 'consider it'] ELSE ['none'] END AS reps, CASE WHEN p_size % 2 = 0 THEN 'rec ' || p_size END AS rec, p_brand FROM part),
tc AS (SELECT *, list_filter(list_transform(reps, lambda x: trim(x)), lambda x: lower(x) <> 'none') AS raw FROM ti WHERE tier <> 0),
ta AS (SELECT *, list_transform(list_filter(raw, lambda x: length(x) <= 60 AND NOT starts_with(lower(x), 'do not') AND NOT starts_with(lower(x), 'consider') AND NOT starts_with(lower(x), 'use with')), lambda y: replace(y, '*', '')) AS alts FROM tc),
tt AS (SELECT *, unnest(CASE lower(slug) WHEN 'blackhat-whitehat' THEN ['blackhat', 'whitehat'] WHEN 'master-slave' THEN ['master/slave', 'master-slave'] WHEN 'sanity-check' THEN ['sanity check'] ELSE [lower(slug)] END) AS term FROM ta)"""


@query(
    "tiered_wordlist_scan",
    O.with_(_TIER_SQL)
    + """SELECT p_partkey, term, CASE WHEN lower(slug) = 'sanity-check' THEN 'ableist' ELSE 'exclusionary' END AS category, array_to_string(alts, ';') AS alternatives,
  CASE WHEN len(alts) = 0 AND len(raw) > 0 THEN trim(coalesce(rec, '') || ' Guidance: ' || array_to_string(raw, '; ')) ELSE coalesce(rec, '') END AS note, '' AS condition, 'tiers ' || p_brand AS source FROM tt""",
)
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 5 == 0, "Blackhat-Whitehat").when(k % 5 == 1, "sanity-check").when(k % 5 == 2, "master-slave").otherwise(F.col("p_name")).alias("term"),
        (size % 4).alias("tier"),
        F.when(size % 3 == 0, F.array(F.lit("None"), F.concat("p_brand", F.lit("*")), F.concat(F.lit(" Consider "), "p_type")))
        .when(size % 3 == 1, F.array(F.concat(F.lit("Do not use "), "p_type"), F.lit("consider it"))).otherwise(F.array(F.lit("none"))).alias("recommended_replacements"),
        F.when(size % 2 == 0, F.concat(F.lit("rec "), size.cast("string"))).alias("recommendation"), F.col("p_brand").alias("term_page"),
    )
    return _flat(L.tiered_entries(rows, "tiers", keep=["p_partkey"]), "p_partkey")


@query(
    "affix_pairs_scan",
    """SELECT s_suppkey, lower(s_name) AS term, 'gendered' AS category, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'person ' || s_nationkey END AS alternatives,
  'gender-marked suffix (affix group: ' || n_name || ')' AS note, '' AS condition, 'pairs' AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = j.select(
        "s_suppkey", F.col("s_name").alias("word"),
        F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit("person "), F.col("s_nationkey").cast("string"))).alias("replacement"),
        F.lit("suffix").alias("affix_type"), F.col("n_name").alias("category"),
    )
    return _flat(L.affix_pair_entries(rows, "pairs", keep=["s_suppkey"]), "s_suppkey")


# three ordered sources from the part table; few distinct names, so terms collide often
_MERGE_SQL = """src AS (SELECT p_partkey, CAST(p_partkey % 3 AS INTEGER) AS s, lower(trim(p_name)) AS term, CASE p_partkey % 7 WHEN 0 THEN 'gendered' WHEN 1 THEN 'ableist' WHEN 2 THEN 'biased' WHEN 3 THEN 'other' ELSE 'outdated' END AS category,
  CASE WHEN p_size % 3 = 0 THEN [p_brand, lower(p_type)] ELSE []::VARCHAR[] END AS alternatives, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size ELSE '' END AS note, CASE WHEN p_size % 7 = 0 THEN p_type ELSE '' END AS condition FROM part),
o AS (SELECT *, s::BIGINT * 1000000000 + p_partkey AS k, p_partkey % 3 AS source FROM src),
nts AS (SELECT term, list_reduce(list_prepend('', list(note ORDER BY k)), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || '; ' || x END) AS note,
  list_reduce(list_prepend('', list(condition ORDER BY k)), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || '; ' || x END) AS condition FROM o GROUP BY term),
hd AS (SELECT term, min(k) AS k, arg_min(category, k) AS category, 'S' || arg_min(source, k) AS source, coalesce(arg_min(alternatives, k) FILTER (len(alternatives) > 0), []::VARCHAR[]) AS alternatives FROM o GROUP BY term),
merged AS (SELECT hd.term, category, alternatives, note, condition, source, k FROM hd JOIN nts USING (term))"""


def merge_sources(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    base = table(spark, sf, "part").select(
        k.alias("row_ord"), (k % 3).alias("s"), F.col("p_name").alias("term"),
        F.when(k % 7 == 0, "gendered").when(k % 7 == 1, "ableist").when(k % 7 == 2, "biased").when(k % 7 == 3, "other").otherwise("outdated").alias("category"),
        F.when(size % 3 == 0, F.array("p_brand", F.lower("p_type"))).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        F.when(size % 2 == 0, F.concat(F.lit("size "), size.cast("string"))).otherwise("").alias("note"),
        F.when(size % 7 == 0, F.col("p_type")).otherwise("").alias("condition"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("source"),
    )
    return L.union_sources(*[base.filter(F.col("s") == i) for i in range(3)])


def merged(spark, sf):
    return L.lexicon_merge(merge_sources(spark, sf))


@query(
    "lexicon_merge",
    O.with_(_MERGE_SQL) + "SELECT term, category, array_to_string(alternatives, ';') AS alternatives, note, condition, source FROM merged",
)
def _(spark, sf):
    return _flat(merged(spark, sf))


@query(
    "lexicon_validate",
    O.with_(_MERGE_SQL)
    + """SELECT term, 'category' AS rule FROM merged WHERE category = 'other' UNION ALL SELECT term, 'empty_entry' FROM merged WHERE len(alternatives) = 0 AND note = '' AND condition = ''""",
)
def _(spark, sf):
    return L.lexicon_violations(merged(spark, sf))


@query("lexicon_counts_by_source", O.with_(_MERGE_SQL) + "SELECT s AS source_ord, count(*) AS n FROM o GROUP BY s")
def _(spark, sf):
    return L.counts_by(merge_sources(spark, sf), "source_ord")


@query("lexicon_counts_by_category", O.with_(_MERGE_SQL) + "SELECT category, count(*) AS n FROM merged GROUP BY category")
def _(spark, sf):
    return L.counts_by(merged(spark, sf), "category")


@query("lexicon_no_duplicates", O.with_(_MERGE_SQL) + "SELECT term, count(*) AS n FROM o GROUP BY term HAVING count(*) > 1")
def _(spark, sf):
    return L.duplicate_terms(L.lexicon_normalize(merge_sources(spark, sf)))


@query(
    "legacy_survival",
    O.with_(_MERGE_SQL) + "SELECT DISTINCT term FROM o WHERE term NOT IN (SELECT term FROM merged WHERE category <> 'outdated')",
)
def _(spark, sf):
    return L.lost_terms(merge_sources(spark, sf), merged(spark, sf).filter("category <> 'outdated'"))


@query(
    "lexicon_json_sink",
    O.with_(_MERGE_SQL)
    + """SELECT term, '{"term":"' || term || '","category":"' || category || '","alternatives":[' || array_to_string(list_transform(alternatives, lambda x: '"' || x || '"'), ',') || ']' ||
  CASE WHEN note <> '' THEN ',"note":"' || note || '"' ELSE '' END || CASE WHEN condition <> '' THEN ',"condition":"' || condition || '"' ELSE '' END || ',"source":"' || source || '"}' AS entry FROM merged""",
)
def _(spark, sf):
    return L.lexicon_json(merged(spark, sf)).select("term", "entry")


# ---- vectors ---------------------------------------------------------------------------------------


def hash_sql(x: str) -> str:
    h = "'0123456789abcdef'"
    digest = f"(sha256(encode({x}) || unhex('0000')) || sha256(encode({x}) || unhex('0001')))"
    raw = f"list_transform(range(0, 64), lambda i: (16.0::DOUBLE * (strpos({h}, substr({digest}, 2 * i + 1, 1)) - 1) + (strpos({h}, substr({digest}, 2 * i + 2, 1)) - 1) - 128.0::DOUBLE) / 128.0::DOUBLE)"
    return raw


def unit_sql(vec: str) -> str:
    return f"list_transform({vec}, lambda z: z / sqrt(list_sum(list_transform({vec}, lambda q: q * q))))"


_VEC_TEXT = "array_to_string(list_transform({v}, lambda u: printf('%.6f', u + 0.0)), ',')"
_BENCH_VEC = f"bq AS (SELECT item_id, {hash_sql('text')} AS raw FROM benchmark)"


@query(
    "hash_embed",
    f"WITH hv AS (SELECT doc_id, {hash_sql('text')} AS raw FROM documents), nv AS (SELECT doc_id, raw, sqrt(list_sum(list_transform(raw, lambda q: q * q))) AS nrm FROM hv) "
    "SELECT doc_id, round(raw[1] / nrm, 6) AS first_value, round(raw[64] / nrm, 6) AS last_value, round(list_sum(list_transform(raw, lambda q: q / nrm)), 6) AS total FROM nv",
)
def _(spark, sf):
    from ..operators.parse import pin

    v = pin(raw_documents(spark, sf).select("doc_id", "text"), "v", hash_embed(F.col("text")))
    return v.select(
        "doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first_value"), F.round(F.get("v", F.lit(63)), 6).alias("last_value"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query(
    "cosine",
    f"""WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS ix FROM embeddings LIMIT 1), m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
ctr AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY label) SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c2.centre), 6) AS score FROM embeddings e JOIN ctr c2 USING (label)""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))


def bench_queries(spark, sf):
    return G.embed_queries(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).select(
        "query_id", "embedding"
    )


_SCORED = f"""{_BENCH_VEC}, sc AS (SELECT item_id AS query_id, vec_id AS id, label, list_cosine_similarity(raw, embedding::DOUBLE[]) AS score FROM bq CROSS JOIN embeddings),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc)"""


@query("vector_topk", O.with_(_SCORED) + "SELECT query_id, id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM rk WHERE r <= 5")
def _(spark, sf):
    return G.vector_topk(bench_queries(spark, sf), evidence_vectors(spark, sf), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_blocked", O.with_(_SCORED) + "SELECT query_id, id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM rk WHERE r <= 5")
def _(spark, sf):
    """The plan for query sets too large to travel: query blocks meet vector blocks by key."""
    return G.vector_topk(bench_queries(spark, sf), evidence_vectors(spark, sf), 5, max_broadcast=0).select(
        "query_id", "id", F.round("score", 6).alias("score"), "rank"
    )


@query(
    "topk_by_doc",
    O.with_(_SCORED)
    + """SELECT query_id, id, label AS doc_key, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM
  (SELECT * FROM rk WHERE r <= 15 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY r) = 1) QUALIFY rank <= 3""",
)
def _(spark, sf):
    return G.topk_by_doc(bench_queries(spark, sf), evidence_vectors(spark, sf), 3).select(
        "query_id", "id", F.col("doc_key").cast("int").alias("doc_key"), F.round("score", 6).alias("score"), "rank"
    )


@query("empty_query_guard", "SELECT event_id FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    q = F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type"))
    return G.embed_queries(table(spark, sf, "events").select("event_id", q.alias("query"))).select("event_id")


@query("distance_to_similarity", "SELECT event_id, round(1.0::DOUBLE - value, 6) AS similarity FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(G.distance_to_similarity(F.col("value")), 6).alias("similarity"))


@query(
    "vector_upsert",
    """WITH w AS (SELECT vec_id AS id, -1 AS batch, vec_id AS ord, 'v' || label AS text FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id, label, 100000 + vec_id, 'w' || label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label + 20, 200000 + vec_id, 'x' || label FROM embeddings WHERE vec_id % 5 = 0)
SELECT id, arg_max(text, batch * 1000000 + ord) AS text, arg_min(ord, batch * 1000000 + ord) AS ord FROM w GROUP BY id""",
)
def _(spark, sf):
    e, k, label = table(spark, sf, "embeddings"), F.col("vec_id"), F.col("label").cast("string")
    store = e.filter(k % 2 == 0).select(k.alias("id"), "embedding", F.concat(F.lit("v"), label).alias("text"), k.alias("ord"))
    b1 = e.filter(k % 3 == 0).select(k.alias("id"), "embedding", F.concat(F.lit("w"), label).alias("text"), (100000 + k).alias("ord"), F.col("label").alias("batch"))
    b2 = e.filter(k % 5 == 0).select(k.alias("id"), "embedding", F.concat(F.lit("x"), label).alias("text"), (200000 + k).alias("ord"), (F.col("label") + 20).alias("batch"))
    return S.vector_upsert(store, b1.unionByName(b2), 64).select("id", "text", "ord")


# ---- search ------------------------------------------------------------------------------------------

_UNESC = "html"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
    _UNESC = f"replace({_UNESC}, '{_a}', '{_b}')"


@query("describe_docs", f"SELECT page_id, {_UNESC} AS description FROM pages WHERE {O.strip('html')} <> ''")
def _(spark, sf):
    docs = table(spark, sf, "pages").withColumnRenamed("html", "description")
    return G.describe_docs(docs).select("page_id", F.col("description_text").alias("description"))


_REQ_SQL = """rq AS (SELECT p_partkey, ['"' || p_name || '"', '(' || lower(p_type) || ')', ' '] AS phrases, [lower(p_type), p_name, 'units', p_brand || ':'] AS any_of, CASE WHEN p_size % 2 = 0 THEN 2000 + p_size END AS min_year, p_name, lower(p_type) AS ty, p_brand AS br FROM part)"""


def search_requests(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.array(F.concat(F.lit('"'), "p_name", F.lit('"')), F.concat(F.lit("("), F.lower("p_type"), F.lit(")")), F.lit(" ")).alias("phrases"),
        F.array(F.lower("p_type"), F.col("p_name"), F.lit("units"), F.concat("p_brand", F.lit(":"))).alias("any_of"),
        F.when(size % 2 == 0, 2000 + size).alias("min_year"),
    )


_GROUP = """'(' || ty || ' OR ' || ty || 's OR "' || p_name || '" OR units OR ' || br || ' OR ' || br || 's)'"""


@query(
    "compile_query",
    O.with_(_REQ_SQL)
    + f"""SELECT p_partkey, '"' || p_name || '" AND "' || ty || '" AND ' || {_GROUP} || ' AND peerreviewed:T' || CASE WHEN min_year IS NOT NULL THEN ' AND publicationdateyear:[' || min_year || ' TO 2026]' ELSE '' END AS strict,
  '"' || p_name || '" AND "' || ty || '" AND ' || {_GROUP} AS relaxed, p_name || ' ' || ty || ' ' || ty || ' ' || p_name || ' units ' || br AS broad FROM rq""",
)
def _(spark, sf):
    r = search_requests(spark, sf)
    args = (F.col("phrases"), F.col("any_of"), F.col("min_year"))
    return r.select(
        "p_partkey", G.compile_query(*args, 1).alias("strict"), G.compile_query(*args, 2).alias("relaxed"), G.compile_query(*args, 3).alias("broad")
    )


@query("term_clean", O.with_(_REQ_SQL) + "SELECT p_partkey, p_name || '|' || ty AS cleaned FROM rq")
def _(spark, sf):
    cleaned = F.filter(F.transform("phrases", G.clean_term), lambda t: t != "")
    return search_requests(spark, sf).select("p_partkey", F.array_join(cleaned, "|").alias("cleaned"))


@query("plural_variants", O.with_(_REQ_SQL) + f"SELECT p_partkey, {_GROUP} AS any_group FROM rq")
def _(spark, sf):
    return search_requests(spark, sf).select("p_partkey", G.or_group(G.plural_variants(F.col("any_of"))).alias("any_group"))


REQUESTS = [
    {"request_id": 1, "phrases": ["that the"], "any_of": ["idiot", "moron"], "min_year": 2010},
    {"request_id": 2, "phrases": ["of the"], "any_of": ["license"], "min_year": None},
    {"request_id": 3, "phrases": ["zzz"], "any_of": ["trash", "stupid"], "min_year": 2000},
    {"request_id": 4, "phrases": ["the"], "any_of": [], "min_year": 2015},
    {"request_id": 5, "phrases": ["no such phrase"], "any_of": [], "min_year": None},
]


def _ladder_sql(requests=None) -> str:
    parts = []
    for r in requests or REQUESTS:
        t = "low"
        allp = " AND ".join(f"contains({t}, '{p}')" for p in r["phrases"]) or "true"
        variants = [v for a in r["any_of"] for v in ([a] if a.endswith("s") else [a, a + "s"])]
        anyv = (" AND (" + " OR ".join(f"contains({t}, '{v}')" for v in variants) + ")") if variants else ""
        year = f" AND try_cast(year AS INTEGER) BETWEEN {r['min_year']} AND 2026" if r["min_year"] else ""
        words = [w for p in r["phrases"] for w in p.split()] + r["any_of"]
        broad = " OR ".join(f"contains({t}, '{w}')" for w in words)
        text = " ".join([*r["phrases"], *r["any_of"]])
        for rung, cond in ((1, f"{allp}{anyv} AND peerreviewed = 'T'{year}"), (2, f"{allp}{anyv}"), (3, broad)):
            parts.append(f"SELECT {r['request_id']} AS request_id, {rung} AS rung, '{text}' AS query, doc_id, description FROM described WHERE {cond}")
    return f"""{_CORPUS_SQL}, described AS (SELECT doc_id, peerreviewed, year, {_UNESC.replace('html', 'chunk_text')} AS description, lower({_UNESC.replace('html', 'chunk_text')}) AS low
  FROM corpus WHERE {O.strip('chunk_text')} <> ''), hit AS ({' UNION ALL '.join(parts)}),
chosen AS (SELECT request_id, min(rung) AS rung FROM (SELECT request_id, rung FROM hit GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
sv AS (SELECT h.*, {hash_sql('query')} AS qv, {hash_sql('description')} AS dv FROM hit h JOIN chosen USING (request_id, rung)),
ladder AS (SELECT *, list_cosine_similarity(qv, dv) AS score, row_number() OVER (PARTITION BY request_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id) AS rank FROM sv QUALIFY rank <= 3)"""


def ladder_corpus(spark, sf):
    return corpus_rows(spark, sf).withColumnRenamed("chunk_text", "description")


@query(
    "search_ladder",
    O.with_(_ladder_sql()) + "SELECT request_id, rung, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ladder",
)
def _(spark, sf):
    return G.search_ladder(REQUESTS, ladder_corpus(spark, sf)).select("request_id", "rung", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    "citation_shape",
    O.with_(_ladder_sql())
    + f"""SELECT l.request_id, CAST(l.rank AS INTEGER) AS rank, 'eric_live_' || l.doc_id AS id, left({_UNESC.replace('html', 'c.title')}, 200) AS title, c.year, 'https://eric.ed.gov/?id=' || l.doc_id AS url FROM ladder l JOIN corpus c USING (doc_id)""",
)
def _(spark, sf):
    out = G.citation_shape(G.search_ladder(REQUESTS, ladder_corpus(spark, sf)))
    return out.select("request_id", "rank", "id", "metadata.title", "metadata.year", "metadata.url")


@query(
    "simple_search_rerank",
    f"""WITH {_CORPUS_SQL}, described AS (SELECT doc_id, {_UNESC.replace('html', 'chunk_text')} AS description FROM corpus WHERE {O.strip('chunk_text')} <> ''),
m AS (SELECT 1 AS request_id, 'idiot license' AS query, * FROM described WHERE contains(lower(description), 'idiot') OR contains(lower(description), 'license') UNION ALL
  SELECT 2, 'worthless', * FROM described WHERE contains(lower(description), 'worthless')),
s AS (SELECT request_id, doc_id, list_cosine_similarity({hash_sql('query')}, {hash_sql('description')}) AS score FROM m)
SELECT request_id, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) <= 3""",
)
def _(spark, sf):
    out = G.simple_search_rerank([(1, "idiot license"), (2, "worthless")], ladder_corpus(spark, sf))
    return out.select("request_id", "doc_id", F.round("score", 6).alias("score"))


# ---- telemetry -----------------------------------------------------------------------------------------


@query(
    "steps_module",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'DocumentAuditor' WHEN 1 THEN 'EvidenceInvestigator' WHEN 2 THEN 'ReportConsolidator' ELSE 'Agent' END AS module FROM conversations""",
)
def _(spark, sf):
    m = F.col("turn") % 4
    task = F.when(m == 0, "audit").when(m == 1, "investigate").when(m == 2, "consolidate").otherwise("route")
    return table(spark, sf, "conversations").select("conv_id", "turn", M.steps_module(task).alias("module"))


@query(
    "steps_response_parse",
    """SELECT event_id, CASE event_type WHEN 'click' THEN '[' || props || ',{"u": ' || user_id || '}]' WHEN 'error' THEN props || ' tail' ELSE props END AS response_value, event_type <> 'error' AS is_json FROM events""",
)
def _(spark, sf):
    t = F.col("event_type")
    raw = F.when(t == "click", F.concat("props", F.lit('\n{"u": '), F.col("user_id").cast("string"), F.lit("}"))).when(
        t == "error", F.concat("props", F.lit(" tail"))
    ).otherwise(F.col("props"))
    steps = table(spark, sf, "events").select("event_id", raw.alias("response"))
    return M.steps_response_parse(steps).select("event_id", "response_value", "is_json")


_STEP_SQL = "steps AS (SELECT user_id AS run_id, event_id AS step_idx, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS tokens_in, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS tokens_out FROM events)"


def ledger_steps(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step_idx"),
        F.when(F.col("event_type") != "error", F.floor("value")).alias("tokens_in"), F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 3).alias("tokens_out"),
    )


_CUM = "cum AS (SELECT *, CAST(sum(coalesce(tokens_in, 0)) OVER w AS BIGINT) AS cum_in, CAST(sum(coalesce(tokens_out, 0)) OVER w AS BIGINT) AS cum_out FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step_idx))"


@query("usage_cumulative", O.with_(_STEP_SQL, _CUM) + "SELECT run_id, step_idx, cum_in, cum_out FROM cum")
def _(spark, sf):
    return M.usage_cumulative(ledger_steps(spark, sf), width=500).select("run_id", "step_idx", "cum_in", "cum_out")


@query(
    "usage_delta",
    """SELECT user_id AS run_id, event_id AS step_idx, event_id * 3 - coalesce(lag(event_id * 3) OVER w, 0) AS delta_in, event_id - coalesce(lag(event_id) OVER w, 0) AS delta_out FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def _(spark, sf):
    ledger = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step_idx"), (F.col("event_id") * 3).alias("cum_in"), F.col("event_id").alias("cum_out")
    )
    return M.usage_delta(ledger, width=500).select("run_id", "step_idx", "delta_in", "delta_out")


_RUN_LOG = """SELECT run_id, count(*) AS step_count, CASE WHEN coalesce(sum(tokens_in), 0) <> 0 OR coalesce(sum(tokens_out), 0) <> 0 THEN CAST(coalesce(sum(tokens_in), 0) AS BIGINT) END AS tokens_in,
  CASE WHEN coalesce(sum(tokens_in), 0) <> 0 OR coalesce(sum(tokens_out), 0) <> 0 THEN CAST(coalesce(sum(tokens_out), 0) AS BIGINT) END AS tokens_out FROM steps GROUP BY run_id"""


@query("run_log_row", O.with_(_STEP_SQL) + _RUN_LOG)
def _(spark, sf):
    return M.run_log_rows(ledger_steps(spark, sf))


@query(
    "error_classify",
    """SELECT event_id, event_type IN ('error', 'click') AS is_refusal FROM events""",
)
def _(spark, sf):
    t = F.col("event_type")
    e = F.when(t == "error", "BadRequestError: Content_Filter hit").when(t == "click", "X: ResponsibleAIPolicyViolation").otherwise(F.concat(F.lit("ValueError: "), t))
    return M.error_classify(table(spark, sf, "events").select("event_id", e.alias("error"))).select("event_id", "is_refusal")


@query(
    "ingest_summary",
    "SELECT count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS ingested, count(*) FILTER (event_type = 'error') AS skipped, CAST(ceil(count(*) FILTER (event_type <> 'error') / 64.0) AS BIGINT) AS batches FROM events",
)
def _(spark, sf):
    return M.ingest_summary(table(spark, sf, "events").select((F.col("event_type") == "error").alias("failed")))


