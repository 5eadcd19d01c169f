"""Chat formatting: read back exactly, loss text, the machine, cases."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm.chat import INST, format_chats, op4_chat, read_back

BITS = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<turn>", "</turn>", "<text>", "\\", "<", "[", "/", " ", "\n", "é", "😀", "a", "$1"]
text = st.one_of(st.none(), st.lists(st.sampled_from(BITS), max_size=8).map("".join))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<text>", None]), text), min_size=1, max_size=40))
def test_roles_and_texts_come_back(spark, turns):
    rows = spark.createDataFrame([(i // 4, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for r in format_chats(rows).select("conv_id", "segments", read_back(F.col("formatted")).alias("turns")).collect():
        own = [(a or "", b or "") for i, (a, b) in enumerate(turns) if i // 4 == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert len([s for s in r["segments"] if s["loss"]]) == sum(a == "assistant" for a, _ in own)


def test_no_control_string_is_left_in_a_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "".join(INST.controls) + "\\")], "conv_id long, turn long, role string, text string")
    body = format_chats(rows).first()["segments"][1]["text"]
    assert not any(c in body for c in INST.controls)


def test_machine(spark):
    orders = {1: "system user assistant", 2: "user assistant user assistant", 3: "user user assistant", 4: "assistant", 5: "user", 6: "user assistant system"}
    rows = spark.createDataFrame([(c, i, r, "t") for c, s in orders.items() for i, r in enumerate(s.split())], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in format_chats(rows).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_cases(spark, data):
    schema = "conv_id long, turn long, role string, text string, valid string"
    rows = spark.createDataFrame([(None, 1, "user", None, "x"), (None, 1, "user", None, "x"), (7, None, None, "a", None)], schema)
    got = {r["conv_id"]: r["n_turns"] for r in format_chats(rows).collect()}
    assert got == {None: 2, 7: 1} and format_chats(rows.limit(0)).count() == 0
    plan = op4_chat(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
