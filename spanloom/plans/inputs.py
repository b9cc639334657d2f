"""Inputs of the registered queries, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import Rule
from ..operators.investigate import Policy
from ..sources.corpus import spread

WINDOW_TOKENS = 200
MAX_WINDOWS = 10

# A small vocabulary of words that occur in the test documents
# (term, category, alternatives, note, condition, source).
LEXICON = (
    ("he", "gendered", ["they"], "pronoun", "when generic", "house"),
    ("the", "exclusionary", ["a", "this", "that", "these"], "", "", "house"),
    ("of the", "biased", ["of"], "two words", "", "house"),
    ("trash", "potentially-offensive", ["waste"], "", "", "insults"),
    ("idiot", "ableist", ["person", "colleague"], "insult", "of a person", "insults"),
    ("worthless", "potentially-offensive", [], "blunt", "of people", "insults"),
    ("moron", "ableist", ["person"], "insult", "", "insults"),
    ("pathetic", "potentially-offensive", ["weak"], "", "of people", "insults"),
    ("stupid", "ableist", ["unwise", "ill-advised", "rash", "hasty"], "", "", "insults"),
    ("disgusting", "potentially-offensive", ["unpleasant"], "tone", "", "insults"),
    ("license", "outdated", ["licence"], "spelling", "", "house"),
)

RULES = (
    Rule("he", "gendered", "they"),
    Rule("idiot", "exclusionary", "person"),
    Rule("moron", "exclusionary", "person"),
    Rule("stupid", "exclusionary", "unwise"),
    Rule("trash", "exclusionary", "waste"),
    Rule("worthless", "exclusionary", "of little use"),
    Rule("pathetic", "gendered", "weak"),
    Rule("disgusting", "gendered", "unpleasant"),
)

#: Limits between the scores that occur in the test tables, and a rule word as the technical one, so that every verdict occurs.
POLICY = Policy(technical="worthless", strong=0.39, sufficient=0.36)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The test documents separate paragraphs by one line break; blocks need a blank line."""
    return raw_documents(spark, sf).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, *e) for i, e in enumerate(LEXICON)]
    return spark.createDataFrame(
        rows, "ord int, term string, category string, alternatives array<string>, note string, condition string, source string"
    )


def evidence_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table as an evidence store; its label is the document key."""
    label = F.col("label").cast("string")
    meta = F.struct(
        F.lit("emb").alias("source"), label.alias("doc_id"), F.concat(F.lit("Evidence "), F.col("vec_id").cast("string")).alias("title"),
        (F.lit(2000) + F.col("label")).cast("string").alias("year"), F.concat(F.lit("https://example.org/"), F.col("vec_id").cast("string")).alias("url"),
    )
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding", label.alias("doc_key"),
        F.concat(F.lit("evidence text "), F.col("vec_id").cast("string")).alias("text"), meta.alias("metadata"),
    )
