"""Lexicon construction: reading term sources, merging them in precedence order, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lit_let, strip

# The categories a finding may carry.
CATEGORIES = (
    "gendered", "exclusionary", "ableist", "outdated", "factually-incorrect",
    "potentially-offensive", "biased",
)
DEFAULT_CATEGORY = "potentially-offensive"

# Category names of the older term list and what they became.
LEGACY_CATEGORIES = {"culturally-insensitive": "potentially-offensive", "ableist-loaded": "ableist"}
LEGACY_CONDITIONS = {
    "ableist-loaded": "when used colloquially/metaphorically, not to describe a disability"
}

# Tiered word list exceptions.
TIERED_TERMS = {
    "blackhat-whitehat": ["blackhat", "whitehat"],
    "master-slave": ["master/slave", "master-slave"],
    "sanity-check": ["sanity check"],
}
TIERED_CATEGORIES = {"sanity-check": "ableist", "cripple": "ableist"}
GUIDANCE_PREFIXES = ("do not", "consider", "use with")
MAX_ALTERNATIVE_LENGTH = 60

ENTRY_COLUMNS = ("term", "category", "alternatives", "note", "condition", "source")


def normalize_term(col: Column) -> Column:
    return F.lower(strip(col))


def lexicon_normalize(entries: DataFrame) -> DataFrame:
    return entries.withColumn("term", normalize_term(F.col("term"))).filter(F.col("term") != "")


def _entries(df: DataFrame, keep: Sequence[str] = (), **cols: Column) -> DataFrame:
    return df.select(*keep, *[cols[c].alias(c) for c in ENTRY_COLUMNS])


def _clean_text(col: Column) -> Column:
    return strip(F.coalesce(col, F.lit("")))


def curated_entries(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Curated rows (alternatives separated by ``|``) to entries."""
    alternatives = F.filter(
        F.transform(F.split(F.coalesce("alternatives", F.lit("")), "\\|"), strip), lambda a: a != ""
    )
    out = _entries(
        rows, keep,
        term=normalize_term(F.col("term")), category=strip(F.col("category")), alternatives=alternatives,
        note=_clean_text(F.col("note")), condition=_clean_text(F.col("condition")),
        source=_clean_text(F.col("source_url")),
    )
    return out.filter(F.col("term") != "")


def legacy_entries(rows: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """Entries of the older list: categories renamed, a condition added for one of them."""
    category, condition = F.col("category"), F.lit("")
    for old, text in LEGACY_CONDITIONS.items():
        condition = F.when(F.col("category") == old, F.lit(text)).otherwise(condition)
    for old, new in LEGACY_CATEGORIES.items():
        category = F.when(F.col("category") == old, F.lit(new)).otherwise(category)
    return _entries(
        rows, keep,
        term=normalize_term(F.col("term")), category=category,
        alternatives=F.coalesce("alternatives", F.array().cast("array<string>")),
        note=F.coalesce("note", F.lit("")), condition=condition, source=F.lit(source),
    )


def _json_strings(col: Column) -> Column:
    """A field that holds a JSON object (its keys count), a JSON list or a plain string, as an array."""
    text = strip(col)
    as_map = F.map_keys(F.from_json(text, "map<string,string>"))
    as_list = F.from_json(text, "array<string>")
    as_one = F.array(text)
    return (
        F.when(text.isNull() | (text == "null"), F.array().cast("array<string>"))
        .when(F.startswith(text, F.lit("{")), as_map)
        .when(F.startswith(text, F.lit("[")), as_list)
        .otherwise(as_one)
    )


def rule_entries(rules: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One rule to one entry per term.

    ``inconsiderate`` and ``considerate`` are a JSON object (its keys count), a JSON list or a
    plain string. ``rules`` also has note, nested_source, condition, category and source_tag.
    Terms with a ``*`` wildcard cannot be matched literally and are dropped.
    """
    note = F.coalesce("note", F.lit(""))
    note = F.when(
        F.coalesce("nested_source", F.lit("")) != "",
        strip(F.concat(note, F.lit(" (see also: "), F.col("nested_source"), F.lit(")"))),
    ).otherwise(note)
    exploded = rules.withColumn("__term", F.explode(_json_strings(F.col("inconsiderate"))))
    out = _entries(
        exploded, keep,
        term=normalize_term(F.col("__term")), category=F.col("category"),
        alternatives=_json_strings(F.col("considerate")), note=note,
        condition=F.coalesce("condition", F.lit("")), source=F.col("source_tag"),
    )
    return out.filter((F.col("term") != "") & ~F.contains("term", F.lit("*")))


def tiered_entries(rows: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """A tiered word list (term, tier, recommended_replacements, recommendation, term_page).

    Tier 0 means no change is advised. Replacements that are prose guidance move to the note
    when no real replacement is left.
    """
    slug = normalize_term(F.col("term"))
    is_word = lambda a: (F.length(a) <= MAX_ALTERNATIVE_LENGTH) & ~reduce(
        lambda x, y: x | y, [F.startswith(F.lower(a), F.lit(p)) for p in GUIDANCE_PREFIXES]
    )
    raw = F.filter(
        F.transform(F.coalesce("recommended_replacements", F.array().cast("array<string>")), strip),
        lambda a: (a != "") & (F.lower(a) != "none"),
    )
    base = (
        rows.filter(F.coalesce(F.col("tier").cast("string"), F.lit("0")) != "0")
        .withColumn("__slug", slug)
        .filter(F.col("__slug") != "")
        .withColumn("__raw", raw)
        .withColumn("__alts", F.transform(F.filter("__raw", is_word), lambda a: F.replace(a, F.lit("*"), F.lit(""))))
    )
    note = F.coalesce("recommendation", F.lit(""))
    note = F.when(
        (F.size("__alts") == 0) & (F.size("__raw") > 0),
        strip(F.concat(note, F.lit(" Guidance: "), F.array_join("__raw", "; "))),
    ).otherwise(note)
    terms, category = F.array("__slug"), F.lit("exclusionary")
    for s, names in TIERED_TERMS.items():
        terms = F.when(F.col("__slug") == s, F.array(*[F.lit(n) for n in names])).otherwise(terms)
    for s, c in TIERED_CATEGORIES.items():
        category = F.when(F.col("__slug") == s, F.lit(c)).otherwise(category)
    exploded = base.withColumn("__term", F.explode(terms))
    return _entries(
        exploded, keep,
        term=F.col("__term"), category=category, alternatives=F.col("__alts"), note=note,
        condition=F.lit(""), source=F.concat(F.lit(source + " "), F.col("term_page")),
    )


def affix_pair_entries(rows: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """Gender-marked word pairs (word, replacement, affix_type, category)."""
    replacement = strip(F.col("replacement"))
    out = _entries(
        rows, keep,
        term=normalize_term(F.col("word")), category=F.lit("gendered"),
        alternatives=F.when(replacement != "", F.array(replacement)).otherwise(F.array().cast("array<string>")),
        note=F.format_string("gender-marked %s (affix group: %s)", "affix_type", "category"),
        condition=F.lit(""), source=F.lit(source),
    )
    return out.filter(F.col("term") != "")


def union_sources(*sources: DataFrame, row_order: str = "row_ord") -> DataFrame:
    """Ordered sources under one roof; ``ord`` = (source position, row position)."""
    tagged = [
        s.withColumn("source_ord", F.lit(i)).withColumn("ord", F.struct(F.lit(i).alias("s"), F.col(row_order).alias("r")))
        for i, s in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _joined_distinct(parts: Column) -> Column:
    """Join texts with '; ', skipping one that the text so far already contains."""
    return F.aggregate(
        parts,
        F.lit(""),
        lambda acc, x: F.when((x == "") | F.contains(acc, x), acc)
        .when(acc == "", x)
        .otherwise(F.concat(acc, F.lit("; "), x)),
    )


def _merged_text(entries: DataFrame, field: str) -> DataFrame:
    """Per term, the first entry's text followed by every later one it does not contain.

    Equal texts are reduced to their first appearance before they meet in one group, so a
    term that repeats in a third of all rows costs one row per distinct text.
    """
    text = F.coalesce(F.col(field), F.lit(""))
    distinct = entries.groupBy("term", text.alias("__x")).agg(F.min("ord").alias("__o")).filter(F.col("__x") != "")
    return distinct.groupBy("term").agg(
        _joined_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("__o", "__x"))), lambda s: s["__x"])
        ).alias(field)
    )


def lexicon_merge(entries: DataFrame) -> DataFrame:
    """Merge entries that carry a sortable ``ord``: first source wins, texts accumulate.

    Output has ``ord`` of the first appearance; sort by it for the merged order.
    """
    e = lexicon_normalize(entries)
    head = e.groupBy("term").agg(
        F.min("ord").alias("ord"),
        F.min_by("category", "ord").alias("category"),
        F.min_by("source", "ord").alias("source"),
        F.min_by(
            F.when(F.size("alternatives") > 0, F.col("alternatives")),
            F.when(F.size("alternatives") > 0, F.col("ord")),
        ).alias("alternatives"),
    )
    out = head
    for field in ("note", "condition"):
        out = out.join(_merged_text(e, field), "term", "left")
    return out.select(
        "term", "category",
        F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"),
        F.coalesce("note", F.lit("")).alias("note"), F.coalesce("condition", F.lit("")).alias("condition"),
        "source", "ord",
    )


def lexicon_violations(lexicon: DataFrame) -> DataFrame:
    """Rows that break a lexicon rule, one per broken rule."""
    rules = F.array(
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), F.lit("category")),
        F.when(F.coalesce(F.col("term"), F.lit("")) == "", F.lit("term")),
        F.when(
            (F.coalesce(F.size("alternatives"), F.lit(0)) <= 0)
            & (F.coalesce("note", F.lit("")) == "")
            & (F.coalesce("condition", F.lit("")) == ""),
            F.lit("empty_entry"),
        ),
    )
    return lexicon.select("term", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def counts_by(lexicon: DataFrame, column: str, name: str = "n") -> DataFrame:
    return lexicon.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def duplicate_terms(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lost_terms(required: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Required terms that the merged lexicon does not hold."""
    return required.select(normalize_term(F.col("term")).alias("term")).distinct().join(
        lexicon.select("term"), "term", "left_anti"
    )


def lexicon_json(lexicon: DataFrame) -> DataFrame:
    """One JSON text per entry, empty note and condition left out."""
    blank_to_null = lambda c: F.nullif(F.col(c), F.lit(""))
    body = F.struct(
        "term", "category", "alternatives",
        blank_to_null("note").alias("note"), blank_to_null("condition").alias("condition"), "source",
    )
    return lexicon.select("term", "ord", F.to_json(body, {"ignoreNullFields": "true"}).alias("entry"))


def note_with_condition(note: Column, condition: Column) -> Column:
    note, condition = F.coalesce(note, F.lit("")), F.coalesce(condition, F.lit(""))
    return (
        F.when(condition == "", note)
        .when(note == "", F.concat(F.lit("condition: "), condition))
        .otherwise(F.concat(F.lit("condition: "), condition, F.lit("; "), note))
    )


def condition_of(note: Column) -> Column:
    """The condition folded into a note: text between its prefix and the first '; '."""
    rest = F.substring(note, len("condition: ") + 1, 2_000_000_000)
    return F.when(
        F.startswith(note, F.lit("condition: ")),
        lit_let(rest, lambda r: F.split_part(r, F.lit("; "), F.lit(1))),
    ).otherwise(F.lit(""))
