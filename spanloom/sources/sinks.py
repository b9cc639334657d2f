"""Writers for corpora, reports, lexicons and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import CORPUS_COLUMNS


def write_corpus(rows: DataFrame, path: str, *, append: bool = True) -> None:
    """Corpus rows as CSV with header, appended or replacing what is there."""
    out = rows.select(*CORPUS_COLUMNS).write.mode("append" if append else "overwrite")
    # white space at the ends of a field belongs to it
    out.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    """One text line per document: JSON reports or any other rendered column."""
    reports.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_markdown(reports: DataFrame, path: str) -> None:
    """Markdown reports with their document key, as parquet (texts hold line breaks)."""
    reports.select("doc_id", "markdown").write.mode("overwrite").parquet(path)


def write_gold(spans: DataFrame, path: str) -> None:
    spans.write.mode("overwrite").json(path)


def write_gold_documents(texts: DataFrame, spans: DataFrame, path: str) -> None:
    """Gold documents as JSON lines: doc_id, fulltext and the spans of each in order (``gold_idx``)."""
    item = F.struct("char_start", "char_end", "labels", "page", "text")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gold_idx", item.alias("s")))).alias("l"))
    joined = texts.join(lists, "doc_id", "left")
    none = F.array().cast(f"array<{lists.select(F.get('l', F.lit(0))['s'].alias('s')).schema['s'].dataType.simpleString()}>")
    rows = joined.select("doc_id", F.col("text").alias("fulltext"), F.coalesce(F.transform("l", lambda x: x["s"]), none).alias("spans"))
    rows.write.mode("overwrite").json(path)


def write_lexicon(entries: DataFrame, path: str) -> None:
    """Serialised entries in merged order."""
    entries.orderBy("ord").select("entry").write.mode("overwrite").text(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    """Append run rows; columns a run does not have stay null."""
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
