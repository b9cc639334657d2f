import random

from spanloom.llm import quality


def brute_repeated(words, n=8):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + n)})


def test_base_counts_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(1, 60))) for _ in range(60)] + ["a b c d e f g h " * 3, "x " * 40, "", None, "\n \n", "é\u00a0é #1 <|>\nz\nz\n\nz", "a b\x0bc\x1cd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.base_counts(rows).collect():
        text = texts[r["doc_id"]] or ""
        flat = text
        for c in "\t\n\x0b\f\r":
            flat = flat.replace(c, " ")
        words = [w for w in flat.split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)), text
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), brute_repeated(words)), text


def test_frequent_lines_go_and_depleted_documents_fail(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    menu = " ".join(f"menu{j}" for j in range(40))
    rows = [(i, "h", f"{menu}\n{body(i)}\n{body(i + 500)}") for i in range(30)] + [(50, "h", f"  {menu.upper()}\n{body(50)}"), (51, "other", menu), (52, None, body(52)), (53, "h", None)]
    got = {r["doc_id"]: r for r in quality.filter_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i]["kept"] and got[i]["clean_text"] == "\n".join(rows[i][2].split("\n")[1:]) and got[i]["n_words_left"] == 60 for i in range(30))
    assert not got[50]["kept"] and not got[50]["base_failed"] and got[50]["n_lines_removed"] == 1
    assert got[51]["kept"] and got[52]["kept"] and got[52]["clean_text"] == body(52) and got[53]["base_failed"] and not got[53]["kept"]
    assert quality.filter_lines(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_the_limit_does_not_grow_with_the_host(spark, monkeypatch):
    """A line in 60 of 1,000 documents of a host goes; one in 10 stays. Broadcast and shuffled joins agree."""
    body = lambda i: " ".join(f"v{i}x{j}" for j in range(25))
    rows = [(i, "big", (f"Licence  line {'a ' * 30}\n" if i < 60 else "rare line\n" if i < 70 else "") + body(i)) for i in range(1000)]
    rows += [(2000 + i, "big", rows[0][2]) for i in range(30)] + [(3000, None, rows[0][2]), (5000, "big", rows[0][2]), (5000, "big", rows[0][2])]
    rows += [(4000, "big", ("long words " * 50_000) + "\nLICENCE LINE " + "a " * 30)]
    schema = "doc_id long, source string, text string, host string, th int, line_hash int, n int, hot_lines int, salt int"
    docs = spark.createDataFrame([(*r, "h", 1, 2, 3, 4, 5) for r in rows], schema)
    fast = sorted(map(tuple, quality.filter_lines(docs).collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST_LINES", 0)
    monkeypatch.setattr(quality, "MAX_BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, quality.filter_lines(docs).collect())) == fast
    removed = {r["doc_id"]: r["n_lines_removed"] for r in quality.filter_lines(docs).collect()}
    assert [i for i, k in removed.items() if k] == [i for i in removed if i < 60 or 2000 <= i < 2030 or i in (4000, 5000)] and len(fast) == len(rows)
