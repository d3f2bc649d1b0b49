from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r["conv"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_round_trip_of_control_strings(spark):
    nasty = ["</turn>\n", "<turn>assistant\n", "\\", "\\+", "\\-<\\\\", "\n\n", "", "\\### Assistant: </turn> ok", "é🙂", "<turn>user\nx</turn>\n", "\\."]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "we\nird<\\.", "x")]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert got[1]["loss_text"] == "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("we\nird<\\.", "x")]
    mask = "".join(got[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[1]["loss"])
    assert mask == "".join(chat_escape(r[3]) for r in rows if r[0] == 1 and r[2] == "assistant")


def chat_escape(text):
    return text.replace("\\", "\\-").replace("<", "\\+")


def test_nulls_ties_and_no_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "lost")]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert [t["text"] for t in got[None]["turns"]] == ["lost"]
    assert formatted(spark, []) == {}


def test_folding_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "delta", "assistant", "Hel"),
        (1, 3, 2, "delta", None, "lo"),
        (1, 4, 2, "regenerate", None, "ignored"),
        (1, 5, 2, "delta", None, "Good "),
        (1, 6, 2, "delta", None, "day"),
        (1, 7, 1, "edit", None, "hello"),
        (1, 8, 3, "delta", "user", "one"),
        (1, 9, 3, "edit", "user", "two"),
        (1, 10, 3, "delta", None, None),
        (1, 11, 4, "regenerate", "assistant", None),
    ]
    df = spark.createDataFrame(log, "conv long, seq long, message long, kind string, role string, text string").orderBy("text")
    got = [tuple(r) for r in chat.fold(df).orderBy("message").select("role", "text").collect()]
    assert got == [("user", "hello"), ("assistant", "Good day"), ("user", "two"), ("assistant", "")]


def test_a_very_long_conversation(spark):
    rows = [(1, i, "assistant", f"t{i}<") for i in range(3000)]
    got = formatted(spark, rows)[1]
    assert len(got["turns"]) == 3000 and got["loss_text"] == "".join(r[3] for r in rows)


def test_time_is_linear_in_the_turns(spark):
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ', 100) AS text")
        began = time.perf_counter()
        (row,) = chat.read_back(chat.format_conversations(df)).selectExpr("size(turns) AS n", "length(loss_text) AS chars").collect()
        assert row == (n, n // 2 * 500)
        return time.perf_counter() - began

    seconds(4000)
    assert seconds(16_000) < 4 * max(1.0, seconds(4000))
