r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is
trainable. Turns after a conversation's last assistant turn follow as one example without a target, so that the
output holds the whole conversation. An example is one string of turns `<|im_start|>role\ntext<|im_end|>\n`; the loss
mask is the span (loss_start, loss_length) of code points in it.

Strings that could pass for marks of this or another common template are broken up inside roles and texts, and can be
restored: `\` becomes `\e`, then a `<` or `[` that starts a mark becomes `\l` or `\b` (in roles, a line feed `\n`).

Contexts repeat earlier turns, so the output grows with the square of a conversation's length; that is the method.
Conversations are gathered by one shuffle of the turns; examples are made and read back where they lie.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows are all kept; rows with a null conversation form one conversation; a very long text, and a conversation of
many turns, is one row of its example, as an example is one string; an empty table gives no example; other columns are
not read, so their names may clash with ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.quality import bind

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"
#: What starts a mark of a common template.
MARK_ANGLE = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|<(?=/?SYS>>)"
MARK_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Text without any string that marks a turn."""
    done = F.replace(text, F.lit("\\"), F.lit("\\e"))
    done = F.regexp_replace(done, MARK_ANGLE, r"\\l")
    return F.regexp_replace(done, MARK_SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    """The inverse of escape: an escaped text has no backslash but those of \\e, \\l and \\b."""
    done = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(done, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns formatted, in order: array of struct(role, head, body)."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    formatted = F.transform(
        "rows",
        lambda r: F.struct(
            r["role"].alias("role"),
            F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("head"),
            escape(r["text"]).alias("body"),
        ),
    )
    return gathered.select("conv_id", formatted.alias("turns"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target, n_turns, formatted, loss_start, loss_length, is_last) from (conv_id, turn, role, text).

    target is the index of the trainable turn, null in an example without one; is_last marks the example that holds
    the whole conversation.
    """
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("turns", i)["role"] == TARGET_ROLE)
    ends = bind(
        replies,
        lambda r: F.when(
            F.coalesce(F.array_max(r), F.lit(-1)) < n - 1, F.array_append(r, n - 1)
        ).otherwise(r),
    )
    spread = conversations(turns).select("conv_id", "turns", F.explode(ends).alias("at"))
    last = F.get("turns", F.col("at"))
    parts = F.transform(F.slice("turns", F.lit(1), F.col("at") + 1), lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    is_reply = last["role"] == TARGET_ROLE
    body_length = F.length(last["body"])
    done = spread.select(
        "conv_id",
        F.when(is_reply, F.col("at")).alias("target"),
        (F.col("at") + 1).alias("n_turns"),
        F.array_join(parts, "").alias("formatted"),
        F.when(is_reply, body_length).otherwise(0).cast("long").alias("loss_length"),
        (body_length + len(END)).cast("long").alias("from_end"),
        (F.col("at") == n - 1).alias("is_last"),
    )
    return done.select(
        "conv_id", "target", "n_turns", "formatted",
        (F.length("formatted") - F.col("from_end")).alias("loss_start"), "loss_length", "is_last",
    )


def read_back(formatted: Column) -> Column:
    """Array of struct(role, text) that a formatted string holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape_role(F.substr(F.substring_index(p, "\n", 1), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, from what its examples hold when read back."""
    whole = F.array_join(
        F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    each = made.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.sha2(whole, 256)).alias("turns_sha256"),
        F.when(F.col("is_last"), F.size(read_back(F.col("formatted")))).alias("n_turns"),
        F.when(F.col("target").isNotNull(), F.struct(F.col("target"), loss.alias("text"))).alias("reply"),
    )
    found = each.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda r: r["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SAMPLE_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one made of marks, read back from the formatted examples."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"), F.lit(SAMPLE_TEXT).alias("text"),
    )
    return digests(examples(turns.unionByName(more)))


def _escaped_length(column: str) -> str:
    marks = r"<(\||/?s>|</?SYS>>|/?SYS>>)|\[/?INST\]"
    return (
        f"(length({column}) + length({column}) - length(replace({column}, chr(92), ''))"
        f" + len(regexp_extract_all({column}, '{marks}')) + len(regexp_extract_all({column}, '<</?SYS>>')))"
    )


QUERIES = {"op7_chat_formatting": op7_chat_formatting}
ORACLES = {
    "op7_chat_formatting": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '{SAMPLE_TEXT}' UNION ALL SELECT -1, 1, '{TARGET_ROLE}', '{SAMPLE_TEXT}'),
lengths AS (SELECT *, {len(START) + 1 + len(END)} + length(role) + {_escaped_length("text")} AS chars FROM rows),
running AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto,
              turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM lengths)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TARGET_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = '{TARGET_ROLE}'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = '{TARGET_ROLE}' OR is_last) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id"""
}
