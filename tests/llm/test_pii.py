import random
import re

from spanloom.llm import pii

# The patterns of the contract, as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and brute_luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    fixed = [
        "a@b.c@d.e", "@x.y", "a@b", "a.b@c-d.e.f.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (800) 555-0199.",
        "+12 ", "++4930123456", "x+1 2 3 4 5 6 7 8)", "", "é@b.cé +4930 1234567é", "1.1.1.0001", "a@b.c.d@e.f", "a@@b.c", "a@b..c", "12345678901234567890",
    ]
    for text in fixed + ["".join(rnd.choices("a1@.+- ()é49", k=rnd.randint(1, 60))) for _ in range(4000)]:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "1." * 100_000, "+1" * 100_000, "@" * 100_000, "+1" + "(" * 200_000, "A" * 100_000 + "9" * 100_000):
        pii.find_spans(text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 BANK") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call 555-867-5309") == ["local_phone"]
    card = pii.find_spans("card 4111111111111111")
    assert card[0][0] == "card" and card[0][3] > pii.find_spans("x 4111111111111111")[0][3]


def test_query_shape_nulls_and_redaction(spark):
    rows = spark.createDataFrame([(1, "mail a@b.co or +4930123456 é", "x"), (2, None, "x"), (3, "", None), (1, "clean", "x")], "doc_id long, text string, pii_spans string")
    found, name = pii.find_pii(rows)
    assert name == "_pii_spans" and set(rows.columns) < set(found.columns)
    assert {(r["doc_id"], len(r[name])) for r in found.collect()} == {(1, 2), (2, 0), (3, 0), (1, 0)}
    got = [r[0] for r in rows.select(pii.redact(rows["text"])).collect()]
    assert got == ["mail [EMAIL] or [PHONE] é", None, "", "clean"]
    assert pii.find_pii(rows.limit(0))[0].count() == 0
