"""Personal data: regular expressions propose spans, checksums confirm them, and nearby context words adjust the score.

Base kinds are ``email, ip, card, phone``: leftmost, non-overlapping per kind, dropped without a retry when their test fails. Further
kinds are ``iban`` (mod-97), ``ssn`` and ``local_phone``; these are kept at a score of ``THRESHOLD`` or more and only where they
touch no base span. Base spans are always kept; their score is information.

Each pattern starts where nothing before it could belong to the match, so a long run of digits or letters costs linear time.

Defined cases: null and empty texts have no spans; very long texts are read whole; repeated rows are judged alike; an empty table
gives no rows; documents keep all their columns, and the result is one array column whose name does not clash.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD = 0.5
#: Characters on both sides of a span in which context words count.
CONTEXT = 40

# Prior score of a kind, and of a passed checksum; words that raise it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "local_phone": 0.35}
CHECKSUM = {"card": 0.5, "iban": 0.5}
WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "debit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"), "local_phone": ("phone", "call", "tel", "mobile", "fax", "number"),
}
BONUS = 0.2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each match has one ``@``; from there the local part is read backwards, not beyond the match before."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def further_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for m in _IBAN.finditer(text):
        # words behind the code may look like a part of it: try each end of a group, the longest first
        ends = [i for i in range(len(m[0]), 14, -1) if i == len(m[0]) or m[0][i] == " "]
        for end in ends:
            code = m[0][:end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                spans.append(("iban", m.start(), m.start() + end))
                break
    spans += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return spans + [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]


def score_of(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    bonus = BONUS if any(re.search(rf"(?<![a-z]){w}", near) for w in WORDS[kind]) else 0.0
    return round(min(1.0, PRIOR[kind] + CHECKSUM.get(kind, 0.0) + bonus), 2)


_DIGIT = re.compile("[0-9]")


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by kind, then start."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    found = [(k, a, b, score_of(text, k, a, b)) for k, a, b in base]
    for kind, a, b in further_spans(text):
        score = score_of(text, kind, a, b)
        if score >= THRESHOLD and not any(x < b and a < y for x, y in taken):
            found.append((kind, a, b, score))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double")))
def spans_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [find_spans(x.as_py() or "") for x in batch]
        yield pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in r] for r in rows], _SPANS)


def redact_text(text: str) -> str:
    """Spans become ``[KIND]``; of overlapping spans the earlier, then the longer one counts."""
    out, last = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


@F.arrow_udf(T.StringType())
def redact_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Null where the text stays as it is."""
    for batch in batches:
        texts = [x.as_py() for x in batch]
        done = [t and redact_text(t) for t in texts]
        yield pa.array([None if a == b else b for a, b in zip(texts, done, strict=True)], pa.string())


def find_pii(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with an array of spans, and the name of that column."""
    name = fresh(docs, "pii_spans")
    return docs.withColumn(name, spans_udf(F.col(text))), name


def redact(text: Column) -> Column:
    return F.coalesce(redact_udf(text), text)


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    found, name = find_pii(table(spark, sf, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter(name, lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"), joined(F.col(name)).alias("spans"),
    )
