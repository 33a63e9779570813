import hashlib
import random

from pyspark.sql import functions as F

from digestry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "<", "[", "\\", "<\\s>", "[\\\\/INST]", "s>", "INST]", "é", "\n", " ", "x"]


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = chat.format_conversations(df)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    return {r["conv_id"]: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    pick = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(pick.randint(1, 7)):
            text = "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 9)))
            rows.append((conv, turn, pick.choice(["user", "assistant", "system", "[INST]"]), text))
    got = formatted(spark, rows)
    for conv in range(60):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["learned"] == "".join(t for r, t in own if r == "assistant")


def test_adjacent_turns_of_one_role_share_a_block(spark):
    got = formatted(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")])[1]
    assert got["formatted"] == "<s>[INST]user[/INST]a[TURN]b</s><s>[INST]assistant[/INST]c</s>"
    (span,) = got["loss"]
    assert got["formatted"][span["start"] : span["start"] + span["length"]] == "c"


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "last"), (1, 0, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "assistant", "n")]
    got = formatted(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("", "x"), ("", "x"), ("user", ""), ("user", "last")]
    assert got[None]["learned"] == "n"


def test_many_turns(spark):
    """Linear in the turns: arrays that are copied per turn would take minutes here."""
    n = 60_000
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}<s>") for i in range(n)]
    got = formatted(spark, rows)[1]
    assert len(got["turns"]) == n and len(got["loss"]) == n - n // 3
    assert got["learned"] == "".join(f"t{i}<s>" for i in range(n) if i % 3)


def test_empty_table_and_long_text(spark):
    assert formatted(spark, []) == {}
    long = "<s>é" * 200_000
    got = formatted(spark, [(5, 0, "assistant", long)])[5]
    assert hashlib.sha256(got["learned"].encode()).digest() == hashlib.sha256(long.encode()).digest()
