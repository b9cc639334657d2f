"""Reading, shaping and extending document and evidence corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers
from ..functions.sizes import broadcast_if_small
from ..functions.text import is_blank, strip
from ..functions.vectors import check_dim, hash_embed

# Columns of a corpus file.
CORPUS_COLUMNS = (
    "chunk_id", "source", "doc_id", "title", "content_type", "chunk_text", "subject", "year", "peerreviewed", "url", "license",
)
TEXT_LIMIT = 8000
#: Bytes up to which an input is dealt out to all cores.
SMALL_INPUT = 1 << 28
#: Bytes of files per task where a larger input is dealt out for work that costs far more than a shuffle.
DEAL_BYTES = 1 << 25
TITLE_LIMIT = 200
#: Splits of a line file up to which their table is broadcast.
MAX_SPLITS = 100_000
BATCH_SIZE = 64

# Labels of the expert review set.
GOLD_FLAGS = {
    "Correct": False, "Biased": True, "Potentially Offensive": True, "Factually Incorrect": True, "Outdated": True,
}
GOLD_CATEGORIES = {
    "Biased": "biased", "Potentially Offensive": "potentially-offensive", "Factually Incorrect": "factually-incorrect", "Outdated": "outdated",
}
# Rows of the review set that serve as examples in a prompt.
EXEMPLAR_ROWS = (2, 6, 10, 16, 24, 28, 30, 35, 42, 45, 56, 64, 78)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Use every core for a small input.

    A small file is one task however many cores there are. Inputs above ``SMALL_INPUT`` bytes, by the size of their files, are
    left as they are, so nothing large is ever shuffled by this.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if int(size) <= SMALL_INPUT else df


def even_tasks(df: DataFrame) -> int | None:
    """Tasks that a large input is dealt out to before costly work, or None for one that :func:`spread` has dealt out already.

    Files are cut at row groups, which may be few and uneven, and a task of the usual 128 MB holds minutes of parsing.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return None if size <= SMALL_INPUT else max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL_BYTES))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path).select("doc_id", "text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, keyed by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus CSV: header, quoted multi-line fields, all text."""
    schema = ", ".join(f"{c} string" for c in CORPUS_COLUMNS)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)


def corpus_scan(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_blank(F.col("chunk_text")))


def corpus_sample(rows: DataFrame, n: int, order: str = "chunk_id") -> DataFrame:
    """The first n rows in file order (``order`` names the column that holds it)."""
    return rows.orderBy(order).limit(n)


def text_truncate(col: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.left(col, F.lit(limit))


def corpus_project(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Identifier, text to embed and metadata of each corpus row; the text is cut only where a limit is given."""
    return rows.select(
        F.concat(F.lit("eric_"), F.coalesce("chunk_id", F.lit("?"))).alias("id"),
        (F.col("chunk_text") if limit is None else text_truncate(F.col("chunk_text"), limit)).alias("text"),
        F.coalesce("source", F.lit("eric")).alias("source"), F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.left(F.coalesce("title", F.lit("")), F.lit(TITLE_LIMIT)).alias("title"),
        F.coalesce("year", F.lit("")).alias("year"), F.coalesce("url", F.lit("")).alias("url"),
    )


def embed_corpus(projected: DataFrame, dim: int = 64, embedder=None) -> DataFrame:
    """Add ``embedding``; ``embedder`` may be any column function (e.g. a pandas UDF)."""
    return projected.withColumn("embedding", embedder(F.col("text")) if embedder else hash_embed(F.col("text"), dim))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon JSON file to one row per entry."""
    schema = (
        "entries array<struct<term:string,category:string,alternatives:array<string>,note:string,condition:string,source:string>>"
    )
    return lexicon_scan(spark.read.schema(schema).json(path, multiLine=True))


def lexicon_scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an ``entries`` array; file order is kept in ``ord``."""
    return files.select(*keep, F.posexplode("entries").alias("ord", "e")).select(
        *keep, "ord", "e.term", "e.category", "e.alternatives", F.coalesce("e.note", F.lit("")).alias("note"),
        F.coalesce("e.condition", F.lit("")).alias("condition"), F.coalesce("e.source", F.lit("")).alias("source"),
    )


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    schema = "term string, category string, alternatives string, note string, condition string, source_url string"
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines rules; the polymorphic fields stay JSON text."""
    return rule_scan(spark.read.text(path))


def rule_scan(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of JSON-lines rules; objects and lists stay JSON text, strings are plain."""
    field = lambda n: F.get_json_object(line, f"$.{n}")
    return lines.select(
        *keep, field("inconsiderate").alias("inconsiderate"), field("considerate").alias("considerate"),
        field("note").alias("note"), field("source").alias("nested_source"), field("condition").alias("condition"),
    )


def _map(col: Column, values: dict, default=None) -> Column:
    return reduce(lambda acc, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(acc), values.items(), F.lit(default))


def gold_sentences(rows: DataFrame, language: str | None = None) -> DataFrame:
    """Review rows (sentence, expected_label_raw, language) with flag and category; unknown labels go."""
    lang = F.coalesce("language", F.lit("EN"))
    out = rows.withColumn("language", lang)
    if language:
        out = out.filter(F.col("language") == language)
    out = out.withColumn("expected_flag", _map(F.col("expected_label_raw"), GOLD_FLAGS).cast("boolean"))
    return out.filter(F.col("expected_flag").isNotNull()).withColumn(
        "expected_category", _map(F.col("expected_label_raw"), GOLD_CATEGORIES).cast("string")
    ).withColumnRenamed("sentence", "text")


def read_gold_sentences(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Review set from CSV with header (sentence, expected_label_raw, language); no rows where the file is missing."""
    schema = "sentence string, expected_label_raw string, language string"
    if not _exists(spark, path):
        return gold_sentences(spark.createDataFrame([], schema), language)
    # Columns are found by name, whatever their order in the file is, so the header is read first.
    found = spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)
    names = [n.split()[0] for n in schema.split(", ")]
    return gold_sentences(found.select(*[F.col(n) if n in found.columns else F.lit(None).cast("string").alias(n) for n in names]), language)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, line): lines with their number in their file, from 0.

    A line is numbered within its split; the lines of the splits before it come from a table of one row per split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"),
    )
    splits = lines.groupBy("file", "split").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = lines.join(broadcast_if_small(starts, MAX_SPLITS), ["file", "split"])
    return joined.select("file", (F.col("start") + F.col("seq") - F.col("first")).alias("row_idx"), "line")


def read_gold_jsonl(spark: SparkSession, path: str, language: str = "EN", exclude: tuple[int, ...] = EXEMPLAR_ROWS) -> DataFrame:
    """Review set from JSON lines (lang, label, sentence); ``row_idx`` is the line number in its file."""
    rows = numbered_lines(spark, path).filter(~is_blank(F.col("line")))
    parsed = F.from_json("line", "lang string, label string, sentence string")
    return gold_jsonl(rows.select("row_idx", parsed.alias("r")).select("row_idx", "r.*"), language, exclude)


def read_gold_documents(spark: SparkSession, path: str) -> DataFrame:
    """Gold documents, one JSON object per line or file: doc_id, fulltext, spans."""
    span = "struct<char_start:bigint,char_end:bigint,labels:array<string>,page:bigint,text:string>"
    return spark.read.schema(f"doc_id string, fulltext string, spans array<{span}>").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def gold_jsonl(rows: DataFrame, language: str = "EN", exclude: tuple[int, ...] = EXEMPLAR_ROWS) -> DataFrame:
    """Review rows (row_idx, lang, label, sentence) of one language without the exemplars."""
    return rows.filter((F.col("lang") == language) & ~F.col("row_idx").isin(*exclude))


def gold_span_rows(files: DataFrame) -> DataFrame:
    """Gold documents (doc_id, spans array) to one row per span."""
    return files.select("doc_id", F.posexplode("spans").alias("gold_idx", "s")).select("doc_id", "gold_idx", "s.*")


def query_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """Non-blank, non-comment lines, trimmed."""
    text = strip(F.col(line))
    return lines.withColumn("query", text).filter((F.col("query") != "") & ~F.startswith("query", F.lit("#")))


def api_doc_normalize(docs: DataFrame, *, source: str = "eric", url: str = "https://eric.ed.gov/?id=") -> DataFrame:
    """Nested API documents to corpus rows without a chunk id; lists are joined by '; '."""

    def text(name: str) -> Column:
        if name not in docs.columns:
            return F.lit("")
        kind = dict(docs.dtypes)[name]
        value = F.array_join(F.col(name).cast("array<string>"), "; ") if kind.startswith("array") else F.col(name).cast("string")
        return F.coalesce(value, F.lit(""))

    keep = [c for c in ("query_idx", "pos") if c in docs.columns]
    return docs.select(
        *keep, F.lit(source).alias("source"), text("id").alias("doc_id"), text("title").alias("title"),
        F.lit("abstract").alias("content_type"), text("description").alias("chunk_text"), text("subject").alias("subject"),
        text("publicationdateyear").alias("year"), text("peerreviewed").alias("peerreviewed"),
        F.when(text("id") != "", F.concat(F.lit(url), text("id"))).otherwise("").alias("url"), F.lit("public-domain").alias("license"),
    )


def corpus_append_dedup(existing: DataFrame, fetched: DataFrame, *, width: int = 100_000) -> DataFrame:
    """New corpus rows: unknown doc_ids, first fetch wins, blank texts dropped, ids continued.

    ``fetched`` has query_idx, pos and the corpus columns. Numbering follows (query_idx, pos)
    without sorting the table in one task: each query is cut into buckets of ``width``
    positions, and only the bucket counts are accumulated.
    """
    usable = fetched.filter((F.col("doc_id") != "") & ~is_blank(F.col("chunk_text")))
    known = existing.select("doc_id").filter("doc_id <> ''").distinct()
    fresh = usable.join(known, "doc_id", "left_anti")
    # The winner of a doc_id is an aggregate, so one that was fetched very often is reduced
    # inside each task before it meets the others.
    rest = [c for c in fresh.columns if c != "doc_id"]
    rows = fresh.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("query_idx", "pos")).alias("r")).select("doc_id", "r.*")
    spacing = 1 << 40
    numbered = row_numbers(
        rows.withColumn("__seq", F.col("query_idx").cast("bigint") * F.lit(spacing) + F.col("pos")), "__seq", "__n", width=width
    ).drop("__seq")
    # One number from one narrow column.
    top = existing.agg(F.coalesce(F.max(F.expr("try_cast(chunk_id AS BIGINT)")), F.lit(0)).alias("n")).first()["n"]
    return numbered.withColumn("chunk_id", (F.lit(top) + F.col("__n")).cast("string")).drop("__n")


def vector_upsert(store: DataFrame, batches: DataFrame, dim: int) -> DataFrame:
    """Vectors by id: the last write wins, the first insertion order stays.

    ``store`` has id, embedding, text, ord; ``batches`` has id, embedding, text, batch and ord,
    where ``ord`` orders all writes. Row groups are reduced by aggregates, so an id written
    very often costs one row per task.
    """
    payload = [c for c in store.columns if c not in ("id", "ord")]
    writes = store.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(batches.select(*store.columns, F.col("batch").cast("bigint")))
    checked = check_dim(writes, "embedding", dim)
    return checked.groupBy("id").agg(
        F.max_by(F.struct(*payload), F.struct("batch", "ord")).alias("p"), F.min(F.struct("batch", "ord"))["ord"].alias("ord")
    ).select("id", "p.*", "ord")


