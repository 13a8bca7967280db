from hypothesis import given
from hypothesis import strategies as st

from featherloom.llm import chat

PIECES = st.lists(st.sampled_from(["<|end|>", "<|turn|>", "<|says|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "\\", "<\\|", "<", "[", "|", "a", "\n", "é😀"]), max_size=12).map("".join)


@given(PIECES)
def test_escape_is_undone_and_leaves_no_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|turn|>"]), PIECES), min_size=1, max_size=6))
def test_round_trip(turns):
    examples = list(chat.expand(iter(turns)))
    assert chat.read_turns(examples[-1][0]) == turns
    trained = [chat.unescape(f[a:b]) for f, a, b in examples if a < b or f.endswith("<|says|><|end|>") and a < len(f)]
    assert [t for t in trained if t] == [t for r, t in turns if r == "assistant" and t]
    assert len(examples) == sum(r == "assistant" for r, _ in turns) + (turns[-1][0] != "assistant")


def test_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, None, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_chats(df)).collect()}
    assert out == {1: (3, 2), 2: (1, 0), None: (1, 1), 3: (3, 3)}
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    first = chat.format_chats(df).where("conv_id = 1 and example = 0").first()
    assert first["formatted"][first["loss_start"] : first["loss_end"]] == "yo"


def test_a_long_conversation(spark):
    df = spark.range(400).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('x', 500) as text")
    r = chat.read_back(chat.format_chats(df)).first()
    assert (r["n_turns"], r["loss_chars"]) == (400, 200 * 500)
