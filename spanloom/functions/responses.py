"""Reading JSON out of model responses."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

def _loads(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def _balanced(text: str) -> Iterator[str]:
    """Balanced ``{...}`` stretches, by the position of their opening brace."""
    closes: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.end()
    for start in sorted(closes):
        yield text[start : closes[start]]


def embedded_json(text: str | None) -> str | None:
    """The first balanced stretch of braces that is JSON."""
    for candidate in _balanced(text or ""):
        ok, value = _loads(candidate)
        if ok:
            return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def _embedded_batch(raw: pd.Series) -> pd.Series:
    return raw.map(embedded_json, na_action="ignore")


def _if_json(text: Column) -> Column:
    """The text itself where it is one JSON value, else null.

    Spark's parsers stop at the end of the first value. As the only item of a list and as a field of an object, both at once,
    the text can be nothing but one whole value.
    """
    listed, field = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"x":'), text, F.lit("}"))
    return F.when((F.json_array_length(listed) == 1) & F.try_parse_json(field).isNotNull(), text)


def response_json(raw: Column) -> Column:
    """The JSON value of a response: all of it, the body of its first code block, or balanced braces; null when there is none.

    The first two are settled in the JVM; only what is left, and has a brace, is looked at in Python.
    """
    body = F.regexp_extract(raw, "(?s)`{3}[^\\n`{\\[]*+([{\\[][^`]*+(?:`(?!``)[^`]*+)*+)`{3}", 1)
    plain = F.coalesce(_if_json(T.strip(raw)), _if_json(T.strip(body)))
    rest = F.when(plain.isNull() & F.contains(raw, F.lit("{")), raw)
    return F.coalesce(plain, _embedded_batch(rest))


def response_object(raw: Column) -> Column:
    """As :func:`response_json`, but only objects count."""
    parsed = response_json(raw)
    return F.when(F.startswith(parsed, F.lit("{")), parsed)


def response_sequence(raw: Column) -> Column:
    """One JSON value as it is, several in a row as a list, anything else null; in the JVM.

    The text is cut into string literals and what stands between them. In JSON no value follows another without a comma or
    colon, so a comma goes wherever one does; the whole is then parsed as a list.
    """
    pieces = F.regexp_extract_all(raw, F.lit('"(?:[^"\\\\]|\\\\.)*+"|[^"]++|"'), F.lit(0))
    ends, begins = "[0-9A-Za-z}\\]]", "[-0-9A-Za-z{\\[]"

    def between(piece: Column, i: Column) -> Column:
        inner = F.regexp_replace(piece, f"(?<={ends})\\s+(?={begins})|(?<=[}}\\]])(?=[{{\\[])", ",")
        after = F.when(i > 0, F.regexp_replace(inner, f"\\A\\s*(?={begins})|\\A\\s+\\z", ",")).otherwise(inner)
        return F.regexp_replace(after, f"(?<={ends})\\s*\\z", ",")

    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(F.startswith(p, F.lit('"')), p).otherwise(between(p, i))), "")
    trimmed = F.regexp_replace(joined, ",?\\s*\\z", "")
    return F.coalesce(_if_json(raw), F.when(trimmed != "", _if_json(F.concat(F.lit("["), trimmed, F.lit("]")))))
