import hashlib
import json
import random

from ledgerlake.llm import chat


def turns_of(spark, *records):
    lines = [(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records]
    return chat.canonical_turns(spark.createDataFrame(lines, "record string"))


def test_layouts_become_canonical_turns(spark):
    turns = turns_of(
        spark,
        {"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"id": "2", "system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]},
        {"id": 3, "prompt": "a", "response": "b"},
        {"id": 4, "instruction": "a", "input": "c", "output": "b"},
        {"id": 5, "instruction": "a", "output": "b"},
        {"data": {"id": 6, "turns": [{"speaker": {"role": "bot"}, "body": {"text": "b"}}]}},
        {"conv_id": 7, "turn": 3, "role": "user", "text": None},
        {"id": 8, "messages": []},
        {"id": 9, "surprise": 1},
        "no json",
        None,
    )
    rows = turns.collect()
    said = {}
    for r in sorted((r for r in rows if r["layout"]), key=lambda r: (r["conversation"], r["place"])):
        said.setdefault(r["conversation"], []).append((r["role"], r["text"]))
    assert said == {
        "1": [("user", "a"), ("assistant", "b")],
        "2": [("system", "s"), ("user", "a"), ("assistant", "")],
        "3": [("user", "a"), ("assistant", "b")],
        "4": [("user", "a"), ("user", "c"), ("assistant", "b")],
        "5": [("user", "a"), ("assistant", "b")],
        "6": [("assistant", "b")],
        "7": [("user", "")],
    }
    assert chat.rejected(turns).count() == 3


def test_template_is_reversible_and_masks_assistants(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("\\<|>end é\U0001f600") for _ in range(rng.randrange(30))) for _ in range(200)]
    texts += ["<|end|>", "<\\|end|>", "\\", "\\<|", chat.START + chat.TEXT, ""]
    records = [{"conv_id": i, "turn": 0, "role": r, "text": t} for i, t in enumerate(texts) for r in ("assistant", t)]
    formatted = chat.format_turns(turns_of(spark, *records)).collect()
    read = sorted((int(r["conversation"]), *chat.read_turn(r["formatted"])) for r in formatted)
    assert read == sorted((x["conv_id"], chat.ROLES.get(x["role"], x["role"]), x["text"]) for x in records)
    for r in formatted:
        if r["loss_start"] is not None:
            part = r["formatted"][r["loss_start"] : r["loss_end"]]
            assert chat.unescape(part) == texts[int(r["conversation"])]


def test_digests_of_one_long_and_many_short_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]
    rows += [(i, 0, "assistant", None) for i in range(2, 40)] + [(99, 5, "user", "tie b"), (99, 5, "user", "tie a")]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    columns = ["conv_id", "turn", "role", "text"]
    turns = chat.canonical_turns(chat.as_records(df, columns))
    got = {int(r["conversation"]): r for r in chat.digests(chat.format_turns(turns)).collect()}
    whole = "".join(f"{('user', 'assistant')[t % 2]}\nturn {t}\n" for t in range(3000))
    loss = "".join(f"turn {t}" for t in range(1, 3000, 2))
    assert got[1]["n_turns"] == 3000 and got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0
    assert got[99]["turns_sha256"] == hashlib.sha256(b"user\ntie a\nuser\ntie b\n").hexdigest()
    assert chat.digests(chat.format_turns(turns_of(spark, "{}"))).count() == 0
