import hashlib

from spanloom.llm import chat


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string")


def texts(spark, rows):
    return [(r["conv_id"], r["msg"], r["role"], r["text"]) for r in chat.fold_events(log(spark, rows)).orderBy("conv_id", "msg").collect()]


def test_fold(spark):
    rows = [
        (1, 0, 3, "delta", None, "b"), (1, 0, 1, "message", "user", ""), (1, 0, 2, "delta", None, "a"),
        (1, 1, 4, "message", "assistant", "old"), (1, 1, 5, "delta", None, " answer"), (1, 2, 6, "message", "user", "thanks"),
        (1, 1, 7, "regenerate", None, None), (1, 1, 8, "delta", None, "new"), (1, 2, 9, "message", "user", "again"),
        (2, 0, 1, "message", "user", "tpyo"), (2, 1, 2, "message", "assistant", "yes"), (2, 0, 3, "edit", None, "typo"), (2, 1, 4, "unknown", None, "zzz"),
        (3, 0, 1, None, None, None), (None, 0, 1, "message", "user", None),
    ]
    assert texts(spark, rows) == [
        (None, 0, "user", ""), (1, 0, "user", "ab"), (1, 1, "assistant", "new"), (1, 2, "user", "again"),
        (2, 0, "user", "typo"), (2, 1, "assistant", "yes"), (3, 0, "", ""),
    ]


def test_regeneration_drops_later_messages(spark):
    rows = [(1, 0, 1, "message", "user", "q"), (1, 1, 2, "message", "assistant", "a"), (1, 2, 3, "message", "user", "more"), (1, 1, 4, "regenerate", None, "b")]
    assert [t[3] for t in texts(spark, rows)] == ["q", "b"]


def test_hostile_texts_come_back(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\<s>\\", "<", "<<SYS>>\n<</SYS>>\n", "\\\\n", "", "a\n</s>\nb", "é\U0001f600<s>", "[[INST]"]
    rows = [(1, i, i, "message", ("user", "assistant", "system", "to ol\n</s>")[i % 4], t) for i, t in enumerate(hostile)]
    made = chat.format_chats(log(spark, rows))
    r = made.select("n_turns", "formatted", chat.parse_turns(made["formatted"]).alias("t"), chat.masked_text(made["formatted"], made["loss_spans"]).alias("loss")).first()
    assert [x["text"] for x in r["t"]] == hostile and r["n_turns"] == len(hostile)
    assert [x["role"] for x in r["t"]] == [x[4] for x in rows]
    assert r["loss"] == "".join(t for t, x in zip(hostile, rows) if x[4] == "assistant")


def test_turn_rows_keep_repeats_and_empty_log(spark):
    rows = spark.createDataFrame([(1, 0, "user", None)] * 2 + [(1, 1, "assistant", "x")] * 3, "conv_id long, turn long, role string, text string")
    r = chat.format_chats(chat.events_of_turns(rows)).first()
    assert r["n_turns"] == 5 and len(r["loss_spans"]) == 3
    assert chat.format_chats(log(spark, [])).count() == 0
    assert hashlib.sha256(b"").hexdigest()
