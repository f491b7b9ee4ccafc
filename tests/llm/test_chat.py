import random

from pyspark.sql import functions as F

from gridloom.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, formatted string, loss int, n int"
ODD = ["<", "|", "\\", "n", "\n", "im_start|>", "im_end|>", "<|im_end|>\n", "<|im_start|>", "user", "a", "é", "<n|", "<\\n|", "<\\|"]


def test_any_text_reads_back(spark):
    rng = random.Random(3)

    def odd(most):
        return "".join(rng.choice(ODD) for _ in range(rng.randint(0, most)))

    rows = [(c, t, odd(3) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), odd(8), "x", 1, 2)
            for c in range(300) for t in range(rng.randint(1, 5))]
    made = chat.format_conversations(spark.createDataFrame(rows, COLUMNS))
    made = made.withColumn("read", chat.under_loss(F.col("formatted"), F.col("loss"))).collect()
    assert len(made) == 300 and all(r.identical for r in made)
    for r in made:
        assert [t.text for t in r.source] == [x[3] for x in sorted(x for x in rows if x[0] == r.conv_id)]
        assert r.read == [t.text for t in r.source if t.role == "assistant"]
        assert r.formatted.count("<|") == 2 * len(r.source)


def test_plain_text_stays_as_it_is(spark):
    rows = [(1, 0, "user", "Hi", "", 0, 0), (1, 1, "assistant", "Ho\n", "", 0, 0)]
    made = chat.format_conversations(spark.createDataFrame(rows, COLUMNS)).first()
    assert made.formatted == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHo\n<|im_end|>\n"


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None, "", 0, 0), (1, 0, "user", "b", "", 0, 0), (1, 0, "user", "a", "", 0, 0),
            (1, 0, "user", "a", "", 0, 0), (None, 0, "assistant", "x" * 100_000, "", 0, 0)]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [(t.role, t.text) for t in made[1].source] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert made[1].identical and made[None].identical and made[1].loss == []
    assert chat.format_conversations(spark.createDataFrame([], COLUMNS)).count() == 0
