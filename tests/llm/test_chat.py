import hashlib
from collections import Counter

from fairlead.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "\\e\\l\\b\\\\", "<<SYS>>x<</SYS>>", "<<s>", "[[INST]", "", "a\nb", "😀<|im_start|>user\n", "plain < [ text"]


def test_escape_is_reversible_and_leaves_no_mark(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    from pyspark.sql import functions as F

    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t
        assert not any(m in r.e for m in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_digests(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(HARD)]
    rows += [(2, 0, "user", "tail only"), (3, 0, None, None), (None, 0, "assistant", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 0, "we\nird</s>", None)]
    rows += [(5, k, "assistant", "long " * 400) for k in range(40)]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA).withColumn("turns", chat.F.lit(1)))
    found = {r.conv_id: r for r in chat.digests(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), sha(loss))
    counts = Counter(r.conv_id for r in made.filter("target IS NOT NULL").collect())
    assert counts == Counter(r[0] for r in rows if r[2] == "assistant")


def test_the_loss_span_is_the_reply(spark):
    made = chat.examples(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2")], SCHEMA)).collect()
    assert sorted(r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in made) == ["r1", "r2"]
    assert sorted(r.n_turns for r in made) == [2, 4]


def test_no_rows(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0
