"""Registered queries that write with a sink and read back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import telemetry as M
from ..sources import corpus as S
from ..sources import sinks
from . import oracle as O
from .catalog_report import _AUDIT, _INV_SQL, _MARKDOWN, _MD_SQL, audit
from .catalog_tables import _CORPUS_SQL, _GOLD_ROWS, _RUN_LOG, _STEP_SQL, _gold_rows, corpus_rows, ledger_steps
from .catalog_text import documents, hits
from .registry import query, scratch


@query("corpus_sink", O.with_(_CORPUS_SQL) + "SELECT chunk_id, doc_id, md5(chunk_text) AS text_md5, md5(title) AS title_md5, year, url FROM corpus")
def _(spark, sf):
    """English rows replace what is there; the others are appended."""
    path, rows = scratch(spark), corpus_rows(spark, sf)
    sinks.write_corpus(rows.filter("subject = 'en'"), path, append=False)
    sinks.write_corpus(rows.filter("subject IS DISTINCT FROM 'en'"), path)
    back = S.read_corpus(spark, path)
    return back.select("chunk_id", "doc_id", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), F.md5(F.col("title").cast("binary")).alias("title_md5"), "year", "url")


@query("report_markdown_sink", O.with_(*O.AUDIT, _INV_SQL, _MD_SQL) + _MARKDOWN)
def _(spark, sf):
    path, a = scratch(spark), audit(spark, sf)
    sinks.write_markdown(R.report_markdown(a.summary, a.findings, a.patterns), path)
    return spark.read.parquet(path)


@query(
    "report_lines_sink",
    _AUDIT + "SELECT '2.0' AS version, s.confirmed, s.rejected, count(d.doc_id) AS n_findings FROM summ s LEFT JOIN decided d USING (doc_id) GROUP BY s.doc_id, s.confirmed, s.rejected",
)
def _(spark, sf):
    """One JSON report per line; the line does not name its document."""
    path, a = scratch(spark), audit(spark, sf)
    sinks.write_reports(R.report_json(a.summary, a.findings, a.patterns), path)
    lines = spark.read.text(path)
    count = lambda n: F.get_json_object("value", f"$.summary.{n}").cast("bigint").alias(n)
    return lines.select(
        F.get_json_object("value", "$.version").alias("version"), count("confirmed"), count("rejected"),
        F.json_array_length(F.get_json_object("value", "$.findings")).cast("bigint").alias("n_findings"),
    )


@query("run_log_sink", O.with_(_STEP_SQL) + _RUN_LOG)
def _(spark, sf):
    """Two appends; rows without tokens are appended without those columns."""
    path, rows = scratch(spark), M.run_log_rows(ledger_steps(spark, sf))
    tokens = F.col("tokens_in").isNull()
    sinks.append_run_log(rows.filter(~tokens), path)
    sinks.append_run_log(rows.filter(tokens).drop("tokens_in", "tokens_out"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "gold_json_sink",
    O.with_(O.DOCS, O.hits())
    + """SELECT CAST(h.doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY h.char_start) - 1 AS INTEGER) AS gold_idx, h.char_start, h.char_end, h.category AS label, h.term AS text, length(d.ft) AS n_chars
  FROM hits h JOIN docs d USING (doc_id)""",
)
def _(spark, sf):
    """Lexicon hits as gold spans of their documents, written as JSON and read back."""
    path = scratch(spark)
    spans = hits(spark, sf).select(
        "doc_id", F.col("char_start").alias("gold_idx"), "char_start", "char_end", F.array("category").alias("labels"),
        F.lit(1).cast("bigint").alias("page"), F.col("term").alias("text"),
    )
    sinks.write_gold_documents(documents(spark, sf), spans, path)
    back = S.read_gold_documents(spark, path)
    rows = back.select("doc_id", F.length("fulltext").alias("n_chars"), F.posexplode("spans").alias("gold_idx", "s"))
    return rows.select("doc_id", "gold_idx", "s.char_start", "s.char_end", F.get("s.labels", F.lit(0)).alias("label"), "s.text", "n_chars")


@query("gold_sentence_file", _GOLD_ROWS + "SELECT md5(text) AS text_md5, raw <> 'Correct' AS expected_flag, CASE WHEN raw <> 'Correct' THEN replace(lower(raw), ' ', '-') END AS expected_category, language FROM g WHERE raw <> 'Unknown' AND language = 'EN'")
def _(spark, sf):
    path = scratch(spark)
    rows = _gold_rows(spark, sf).select("language", "sentence", "expected_label_raw")
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = S.read_gold_sentences(spark, path, "EN")
    return back.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "expected_flag", "expected_category", "language")
