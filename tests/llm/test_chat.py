import hashlib

from stackroom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}


def test_round_trip_of_control_strings(spark):
    said = ["\\### Assistant: </turn> ok", "\\b\\h\\l\\c\\\\", "### user: </turn>\n", ":: # < \\", "", "é\n\n😀", "a" * 200_000]
    rows = [(i, t, role, text) for i, text in enumerate(said) for t, role in enumerate(["user", "assistant"])]
    got = formatted(spark, rows)
    for i, text in enumerate(said):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", text), ("assistant", text)]
        assert got[i].trained == text and got[i].valid
        assert "".join(s.text for s in got[i].segments) == got[i].formatted


def test_machine(spark):
    order = {1: "ua", 2: "sua", 3: "su", 4: "au", 5: "uu", 6: "uaua", 7: "s", 8: "suas", 9: "ux"}
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    got = formatted(spark, [(i, t, role[c], "t") for i, cs in order.items() for t, c in enumerate(cs)])
    assert {i for i, r in got.items() if r.valid} == {1, 2, 6}
    assert [t.role for t in got[9].turns] == ["user", "tool"]


def test_nulls_ties_and_hash(spark):
    got = formatted(spark, [(None, 0, "user", "q"), (None, 1, "assistant", None), (2, 0, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, None, "user", "z")])
    assert got[None].valid and got[None].trained == ""
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and not got[2].valid
    assert [t.text for t in got[3].turns] == ["z", "a", "b"]


def test_empty(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).isEmpty()


def test_query_has_the_extra_conversation(spark, small):
    row = chat.op1_chat_formatting(spark, small).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.loss_chars == len(said) and row.n_turns == 2
