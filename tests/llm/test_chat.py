import hashlib
import random

from linkloom.llm import chat
from linkloom.llm.chat import format_chats, read_turns, sorted_turns


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<|", "<\\|", "\\n", "\n", "<", "|", "", "é", "assistant\n", "user"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb\\", "<|x"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for c in range(60) for t in range(rng.randint(1, 9))]
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in format_chats(table(spark, rows)).select("conv_id", read_turns(chat.F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert got == want


def test_merging_masks_and_template(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b<|"), (1, 3, "user", None)]
    r = format_chats(table(spark, rows)).first()
    assert r["n_messages"] == 3
    assert r["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<\\|<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["a", "b<\\|"]


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, 5, "b", "y"), (1, None, "z", "first"), (1, 5, "a", "z"), (1, 5, "b", "x"), (1, 5, "b", "x"), (None, 0, None, None)]
    df = table(spark, rows).selectExpr("*", "1 AS segments", "2 AS turns", "'q' AS formatted")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in sorted_turns(df).collect()}
    assert got == {1: [("z", "first"), ("a", "z"), ("b", "x"), ("b", "x"), ("b", "y")], None: [("", "")]}
    assert format_chats(df).count() == 2
    assert format_chats(df.limit(0)).count() == 0


def test_long_conversation_is_sorted_across_blocks(spark):
    n = 3 * chat.TURNS_PER_BLOCK + 7
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(n)]
    random.Random(2).shuffle(rows)
    turns = format_chats(table(spark, rows)).select(read_turns(chat.F.col("formatted")).alias("turns")).first()["turns"]
    assert [t["text"] for t in turns] == [f"t{i}" for i in range(n)]


def test_query_adds_the_probe(spark, tmp_path):
    table(spark, [(7, 0, "user", "q"), (7, 1, "assistant", "añ")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(probe)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert got[7]["loss_sha256"] == hashlib.sha256("añ".encode()).hexdigest() and got[7]["loss_chars"] == 2
