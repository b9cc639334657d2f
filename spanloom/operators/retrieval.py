"""Evidence retrieval: vector search with document dedup, and a strict-to-broad search ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sizes import broadcast_if_small, cut_lineage, fits
from ..functions.terms import BLOCK_CHARS, found_terms
from ..functions.vectors import MAX_BROADCAST_QUERIES, cosine, digest_embed, hash_embed, text_digest, top_k

OVER_FETCH = 5
MIN_RUNG_DOCS = 3
MAX_YEAR = 2026
TITLE_LIMIT = 200


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, *, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    return top_k(queries, vectors, k, max_broadcast=max_broadcast)


def topk_by_doc(queries: DataFrame, vectors: DataFrame, k: int = 3, *, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The k best documents per query, each by its best vector (its own id where it has no document).

    One search: tasks keep k documents per query, so a document with very many of the best vectors hides no other and nothing
    is fetched twice. ``vectors`` also has ``doc_key`` (nullable) and may carry ``payload`` columns.
    """
    extra = [c for c in vectors.columns if c not in ("id", "ord", "embedding")]
    doc_of = F.coalesce(F.nullif(F.col("doc_key").cast("string"), F.lit("")), F.col("id").cast("string"))
    hits = top_k(queries, vectors.withColumn("__doc", doc_of), k, group="__doc", max_broadcast=max_broadcast)
    # Only the best pick up their attributes: k rows per query, so with few queries they travel and the vector table is not shuffled.
    few = fits(queries, max_broadcast)
    return vectors.select("ord", *extra).join(F.broadcast(hits) if few else hits, "ord")


def embed_queries(queries: DataFrame, text: str = "query", *, dim: int = 64) -> DataFrame:
    """Vectors for non-blank query texts; blank ones get no rows."""
    return queries.filter(~T.is_blank(F.col(text))).withColumn("embedding", hash_embed(F.col(text), dim))


def distance_to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance.cast("double")


def describe_docs(docs: DataFrame, description: str = "description", limit: int | None = None) -> DataFrame:
    """Join list-valued descriptions, undo HTML escapes, drop blank ones; cut them only where a limit is given."""
    is_list = dict(docs.dtypes)[description].startswith("array")
    joined = F.array_join(description, "; ") if is_list else F.coalesce(F.col(description), F.lit(""))
    text = T.html_unescape(joined)
    described = docs.withColumn("description_text", text).filter(~T.is_blank(F.col("description_text")))
    return described if limit is None else described.withColumn("description_text", F.left("description_text", F.lit(limit)))


# ---- query compiler -----------------------------------------------------------------------


def clean_term(col: Column) -> Column:
    """Drop the characters that would break a search expression."""
    return T.strip(F.translate(col, '"():[]', ""))


def plural_variants(terms: Column) -> Column:
    """Word and word + s for single words, a quoted phrase for several, first mention kept."""
    cleaned = F.filter(F.transform(terms, clean_term), lambda t: t != "")
    variants = F.transform(
        cleaned,
        lambda t: F.when(F.contains(t, F.lit(" ")), F.array(F.concat(F.lit('"'), t, F.lit('"'))))
        .when(F.endswith(t, F.lit("s")), F.array(t))
        .otherwise(F.array(t, F.concat(t, F.lit("s")))),
    )
    return F.array_distinct(F.flatten(variants))


def or_group(variants: Column) -> Column:
    return (
        F.when(F.size(variants) == 0, "")
        .when(F.size(variants) == 1, F.get(variants, F.lit(0)))
        .otherwise(F.concat(F.lit("("), F.array_join(variants, " OR "), F.lit(")")))
    )


def compile_query(phrases: Column, any_of: Column, min_year: Column, rung: int, max_year: int = MAX_YEAR) -> Column:
    """The search expression of one rung: 1 strict, 2 without filters, 3 all words."""
    clean = F.filter(F.transform(phrases, clean_term), lambda p: p != "")
    if rung == 3:
        words = F.flatten(F.transform(clean, lambda p: F.filter(F.split(p, T.WS + "+"), lambda w: w != "")))
        others = F.filter(F.transform(any_of, clean_term), lambda t: t != "")
        return F.array_join(F.concat(words, others), " ")
    quoted = F.transform(clean, lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    group = or_group(plural_variants(any_of))
    clauses = F.concat(quoted, F.when(group != "", F.array(group)).otherwise(F.array().cast("array<string>")))
    if rung == 1:
        year = F.format_string(f"publicationdateyear:[%d TO {max_year}]", min_year)
        tail = F.when(F.coalesce(min_year, F.lit(0)) != 0, F.array(F.lit("peerreviewed:T"), year)).otherwise(
            F.array(F.lit("peerreviewed:T"))
        )
        clauses = F.concat(clauses, tail)
    return F.array_join(clauses, " AND ")


# ---- search over a corpus table -----------------------------------------------------------


_REQUEST = "request_id {}, phrases array<string>, any_of array<string>, min_year int"


def as_requests(spark: SparkSession, requests: list[dict]) -> DataFrame:
    """A short list of requests as the table that the searches read."""
    kind = "string" if any(isinstance(r["request_id"], str) for r in requests) else "int"
    rows = [(r["request_id"], list(r["phrases"]), list(r["any_of"]), r["min_year"]) for r in requests]
    return spark.createDataFrame(rows, _REQUEST.format(kind))


def _terms_of(requests: DataFrame) -> DataFrame:
    """Requests with their cleaned ``all`` (phrases), ``some`` (words and plurals) and ``words``; blank requests go."""
    empty = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, empty), lambda t: F.lower(clean_term(t))), lambda t: t != "")
    out = requests.withColumn("all", F.array_distinct(clean(F.col("phrases")))).withColumn("__any", clean(F.col("any_of")))
    plural = F.transform("__any", lambda t: F.when(F.contains(t, F.lit(" ")) | F.endswith(t, F.lit("s")), F.array(t)).otherwise(F.array(t, F.concat(t, F.lit("s")))))
    words = F.filter(F.flatten(F.transform("all", lambda p: F.split(p, T.WS + "+"))), lambda w: w != "")
    return out.withColumn("some", F.array_distinct(F.flatten(plural))).withColumn("words", F.array_distinct(F.concat(words, "__any"))).drop("__any").filter(F.size("words") > 0)


def search_ladder(
    requests: DataFrame | list[dict], corpus: DataFrame, *, k: int = 3, max_rows: int | None = None, max_year: int = MAX_YEAR,
    dim: int = 64, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Answer a table of requests (request_id, phrases, any_of, min_year) from a corpus table, however many they are.

    The terms of all requests are looked for in one scan of the corpus (doc_id, title, description, peerreviewed, year) per block
    of terms. What leaves it is a row per document and term; requests meet these rows by term, and the rungs follow from counts: all
    phrases and one of the other terms (strict: reviewed and in time as well). The first rung with at least three described
    documents answers; only requests without an answer go on to the third rung, any word. Its documents are ranked by cosine to the
    request text, for which the scan gives a digest of each matching text; only the texts of the k best are fetched, in a second scan.
    Every match takes part; ``max_rows`` caps them in doc_id order when given. Blank requests have no answer.
    """
    requests = as_requests(corpus.sparkSession, requests) if isinstance(requests, list) else requests
    asked = cut_lineage(_terms_of(requests))
    # Few requests with many matches each would be a few large groups of a join by request; broadcast, they need none.
    few = F.broadcast if fits(asked, MAX_BROADCAST_QUERIES) else lambda df: df
    described = describe_docs(corpus).select("doc_id", "title", "year", "peerreviewed", "description_text")
    described = described.withColumn("row", F.xxhash64(*described.columns))
    terms = asked.select(F.explode(F.array_union(F.array_union("all", "some"), "words")).alias("term")).distinct()
    scanned = described.withColumns({"low": F.lower("description_text"), "digest": text_digest(F.col("description_text"), dim)})
    held = cut_lineage(found_terms(scanned, "low", ["doc_id", "row", "year", "peerreviewed", "digest"], terms, block_chars))
    is_all, is_some = F.col("role") == "all", F.col("role") == "some"
    roles = F.concat(F.transform("all", lambda t: F.struct(F.lit("all").alias("role"), t.alias("term"))), F.transform("some", lambda t: F.struct(F.lit("some").alias("role"), t.alias("term"))))
    wanted = asked.select("request_id", "min_year", F.size("all").alias("n_all"), F.size("some").alias("n_some"), F.inline(roles))
    met = held.join(broadcast_if_small(wanted, MAX_BROADCAST_QUERIES), "term").groupBy("request_id", "doc_id", "row").agg(
        F.count_if(is_all).alias("has_all"), F.count_if(is_some).alias("has_some"),
        *[F.first(c).alias(c) for c in ("year", "peerreviewed", "digest", "min_year", "n_all", "n_some")],
    ).filter((F.col("has_all") == F.col("n_all")) & ((F.col("n_some") == 0) | (F.col("has_some") > 0)))
    late = F.coalesce("min_year", F.lit(0)) == 0
    strict = (F.col("peerreviewed") == "T") & (late | F.coalesce(F.expr("try_cast(year AS INT)").between(F.col("min_year"), max_year), F.lit(False)))
    relaxed = cut_lineage(met.select("request_id", "doc_id", "row", "digest", F.coalesce(strict, F.lit(False)).alias("strict")))
    counts = relaxed.groupBy("request_id").agg(F.count_if("strict").alias("n1"), F.count(F.lit(1)).alias("n2"))
    chosen = counts.filter(F.col("n2") >= MIN_RUNG_DOCS).select("request_id", F.when(F.col("n1") >= MIN_RUNG_DOCS, 1).otherwise(2).alias("rung"))
    first = relaxed.join(few(chosen), "request_id").filter((F.col("rung") == 2) | F.col("strict")).select("request_id", "rung", "doc_id", "row", "digest")
    broad = asked.join(few(chosen), "request_id", "left_anti").select("request_id", F.explode("words").alias("term"))
    any_word = held.join(broadcast_if_small(broad, MAX_BROADCAST_QUERIES), "term").select("request_id", F.lit(3).alias("rung"), "doc_id", "row", "digest").distinct()
    enough = any_word.groupBy("request_id").agg(F.count(F.lit(1)).alias("n3")).filter(F.col("n3") >= MIN_RUNG_DOCS).select("request_id")
    rows = first.unionByName(any_word.join(few(enough), "request_id"))
    if max_rows is not None:
        cap = Window.partitionBy("request_id").orderBy("doc_id")
        rows = rows.withColumn("__n", F.row_number().over(cap)).filter(F.col("__n") <= max_rows).drop("__n")
    query = F.concat_ws(" ", F.coalesce("phrases", F.array().cast("array<string>")), F.coalesce("any_of", F.array().cast("array<string>")))
    # Narrow rows are ranked; the few best then meet their texts, so no text is dealt out at all.
    told = few(asked.select("request_id", query.alias("query")))
    scored = rows.join(few(asked.select("request_id", hash_embed(query, dim).alias("__q"))), "request_id").withColumn("score", cosine(F.col("__q"), digest_embed(F.col("digest"), dim)))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "doc_id")
    best = cut_lineage(scored.drop("__q", "digest").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    keys = broadcast_if_small(best.select("doc_id").distinct(), MAX_BROADCAST_QUERIES)
    texts = describe_docs(corpus.join(keys, "doc_id", "left_semi")).select("doc_id", "title", "year", "peerreviewed", "description_text")
    texts = texts.withColumn("row", F.xxhash64(*texts.columns)).drop("peerreviewed").dropDuplicates(["doc_id", "row"])
    return best.join(told, "request_id").join(texts, ["doc_id", "row"]).drop("row")


def simple_search_rerank(queries: DataFrame | list[tuple[int, str]], corpus: DataFrame, *, k: int = 3, dim: int = 64, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One broad search per query text (request_id, query), all its matches ranked, top k; blank queries have none."""
    if isinstance(queries, list):
        queries = corpus.sparkSession.createDataFrame(queries, "request_id int, query string")
    words = F.filter(F.split("query", T.WS + "+"), lambda w: w != "")
    asked = queries.select("request_id", words.alias("words")).filter(F.size("words") > 0).select("request_id", F.array_join("words", " ").alias("query"), "words")
    wanted = asked.select("request_id", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))
    described = describe_docs(corpus).select("doc_id", "title", "year", "description_text")
    described = described.withColumn("row", F.xxhash64(*described.columns))
    held = found_terms(described.withColumn("low", F.lower("description_text")), "low", ["doc_id", "row"], wanted.select("term").distinct(), block_chars)
    rows = held.join(broadcast_if_small(wanted, MAX_BROADCAST_QUERIES), "term").select("request_id", "doc_id", "row").distinct()
    narrow = rows.join(broadcast_if_small(asked.select("request_id", "query"), MAX_BROADCAST_QUERIES), "request_id")
    return rerank(narrow.join(described, ["doc_id", "row"]).drop("row"), k, dim=dim)


def rerank(rows: DataFrame, k: int, *, dim: int = 64) -> DataFrame:
    """Rank matched documents of each request by cosine to its query text."""
    scored = rows.withColumn("score", cosine(hash_embed(F.col("query"), dim), hash_embed(F.col("description_text"), dim)))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def citation_shape(ranked: DataFrame, source: str = "eric_live", url: str = "https://eric.ed.gov/?id=") -> DataFrame:
    """Citations: id, text, score and a metadata struct."""
    doc = F.col("doc_id").cast("string")
    rung = F.col("rung") if "rung" in ranked.columns else F.lit(None).cast("int")
    meta = F.struct(
        F.lit(source).alias("source"), F.coalesce(doc, F.lit("")).alias("doc_id"),
        F.left(T.html_unescape(F.coalesce("title", F.lit(""))), F.lit(TITLE_LIMIT)).alias("title"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit(url), doc)).otherwise("").alias("url"),
        rung.alias("rung"),
    )
    return ranked.select(
        "request_id", "rank", F.concat(F.lit(f"{source}_"), F.coalesce(doc, F.lit(""))).alias("id"),
        F.col("description_text").alias("text"), "score", meta.alias("metadata"),
    )

