"""Templates that count turns see all of them."""

from ledgernet.llm import chat_format as chat


def test_a_counting_template_gives_its_own_rendering(spark):
    def counted(turns):
        for k, t in enumerate(turns):
            if t["role"] != ("assistant" if k % 2 else "user"):
                raise ValueError(f"turn {k} is of {t['role']}")
        return "".join(f"<{k}:{t['role']}>{t['text']}\n" for k, t in enumerate(turns))

    turns = [{"role": "assistant" if k % 2 else "user", "text": f"turn {k}"} for k in range(200)]
    rows = [(1, k, t["role"], t["text"]) for k, t in enumerate(turns)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.chat_format(conv, counted).collect(), key=lambda x: x["seq"])
    whole = "".join(x["piece"] for x in got)
    assert whole == counted(turns) and not any(x["rewritten"] for x in got)
    assert [whole[x["loss_start"]:x["loss_end"]] for x in got if x["loss_start"] is not None] == [
        t["text"] for t in turns if t["role"] == "assistant"]

    def forgets(turns):  # history is rewritten once there are 100 turns
        return "".join(t["text"] if len(turns) < 100 or k else "..." for k, t in enumerate(turns))
    marks = [x["seq"] for x in chat.chat_format(conv, forgets).collect() if x["rewritten"]]
    assert marks == [99]


def test_only_a_declared_template_is_bounded():
    seen = []

    def noted(turns):
        seen.append(len(turns))
        return "".join(t["text"] for t in turns)
    for context, most in ((None, 100), (10, 10)):
        seen.clear()
        r = chat.Renderer(noted, context)
        for k in range(100):
            r.push({"role": "user", "text": f"{k};"})
        assert max(seen) == most
    assert chat.Renderer(chat.turn_template).context == chat.CONTEXT
