"""Text primitives as Spark columns.

Spark's regular expressions run on java.util.regex, whose ``\\s``, ``\\d``, ``\\w`` and
``\\b`` are ASCII by default. Every pattern in this package spells its character classes
out instead, so white space, digits and word boundaries mean the same thing for every
language in the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as regex classes. Common characters are told apart by the first
# range test; the rare ones sit behind an intersection that plain text never enters.
_RARE_WS = "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS = f"[\\t-\\r\\x1c-\\x20[\\x85-\\u3000&&[\\x85\\xa0{_RARE_WS}]]]"
NOT_WS = f"[\\x21-\\x84\\x00-\\x08\\x0e-\\x1b[\\x86-\\x{{10ffff}}&&[^\\xa0{_RARE_WS}]]]"
WORD = "[a-zA-Z0-9_[\\x80-\\x{10ffff}&&[\\p{L}\\p{N}]]]"
TOKENS_PER_WORD = 1.3


def lit_let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column captured by a lambda is evaluated again for every element; going through a
    one-element array turns it into a lambda variable, which is evaluated exactly once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~F.rlike(col, F.lit(NOT_WS)), F.lit(True))


def collapse_ws(col: Column) -> Column:
    return strip(F.regexp_replace(col, WS + "+", " "))


def word_count(col: Column) -> Column:
    """Runs without white space. Each gives way to one letter, together with the white space around it, as a count of matches would
    make a string of every word."""
    return F.length(strip(F.regexp_replace(col, f"{WS}*+{NOT_WS}++{WS}*+", "x")))


def token_estimate(col: Column) -> Column:
    return word_count(col) * F.lit(TOKENS_PER_WORD)


def latin_ratio(col: Column) -> Column:
    """Share of a-z among the letters; null when the text has no letter."""
    letters = F.length(F.regexp_replace(col, "[^\\p{L}]+", ""))
    latin = F.length(F.regexp_replace(col, "[^A-Za-z\\u212a\\u0130]+", ""))
    return F.when(letters > 0, latin / letters)


def is_english(col: Column) -> Column:
    """Whether at least half of the letters are a-z; false for a text without letters.

    Other letters are counted first: plain English text has none, and one scan settles it. Next come the runs of a-z, each at least
    one letter: only where these are fewer than the other letters is every letter counted.
    """
    others = F.regexp_count(col, F.lit("[\\x80-\\x{10ffff}&&[\\p{L}&&[^\\u212a\\u0130]]]"))
    runs = F.regexp_count(col, F.lit("[A-Za-z]++"))
    latin = F.length(F.regexp_replace(col, "[^A-Za-z\\u212a\\u0130]+", ""))
    verdict = lit_let(
        others,
        lambda n: F.when(n == 0, F.rlike(col, F.lit("[A-Za-z\\u212a\\u0130]"))).otherwise((runs >= n) | (latin >= n)),
    )
    return F.coalesce(verdict, F.lit(False))


def escape_literal(text: str) -> str:
    """A Java regex that matches ``text`` literally."""
    return re.sub(r"([^0-9A-Za-z_\s\u0080-\uffff])", r"\\\1", text).replace(" ", "\\x20")


def escape_column(col: Column) -> Column:
    return F.regexp_replace(col, "([\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e])", "\\\\$1")


def word_boundaries(term: str) -> tuple[str, str]:
    """Look-arounds equal to a Unicode word boundary on both sides of ``term``."""

    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    before = f"(?<!{WORD})" if is_word(term[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if is_word(term[-1]) else f"(?={WORD})"
    return before, after


def case_flags(text: str) -> str:
    """Flags that ignore case; the cheaper ASCII form where the text allows it."""
    return "i" if text.isascii() else "iu"


def word_regex(term: str) -> str:
    """``term`` as a whole word, whatever case. Its first letter is looked for before the look-around, which costs more."""
    before, after = word_boundaries(term)
    first = f"(?=[{term[0].lower()}{term[0].upper()}])" if term.isascii() and term[0].isalpha() else ""
    return f"{first}{before}(?{case_flags(term)}:{escape_literal(term)}){after}"


def phrase_regex(quote: Column) -> Column:
    """Words of ``quote`` joined by any white space, as a regex column; '' when blank."""
    words = F.filter(F.split(strip(quote), WS + "+"), lambda w: w != "")
    return F.array_join(F.transform(words, escape_column), WS + "+")


def html_unescape(col: Column) -> Column:
    """Undo the five predefined entities plus the common numeric forms."""
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#x27;", "'"),
        ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"),
    ):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col
