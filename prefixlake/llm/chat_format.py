"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it, formatted, are the context, and only that reply
(with its end mark) is the target. The template is

    [SYSTEM_PROMPT]text[/SYSTEM_PROMPT]   [INST]text[/INST]   text</s>   [ROLE name]text[/ROLE]

for system, user, assistant and any other role. Inside texts and role names ``\\``, ``<``, ``[`` and ``]`` are written
``\\e``, ``\\l``, ``\\b`` and ``\\c``, so no control string can occur there, and reading back is exact.

All of it is DataFrame functions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order for writing, in reverse for reading.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))
END = "</s>"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(role: Column, text: Column) -> Column:
    """One turn under the template. Null roles and texts count as empty."""
    role, body = F.coalesce(role, F.lit("")), escaped(F.coalesce(text, F.lit("")))
    return (
        F.when(role == "assistant", F.concat(body, F.lit(END)))
        .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "system", F.concat(F.lit("[SYSTEM_PROMPT]"), body, F.lit("[/SYSTEM_PROMPT]")))
        .otherwise(F.concat(F.lit("[ROLE "), escaped(role), F.lit("]"), body, F.lit("[/ROLE]")))
    )


#: Groups: the opening mark's kind, another role's name, the text, the end mark.
TURN = r"(?:\[(SYSTEM_PROMPT|INST|ROLE ([^\]]*))\])?([^\[<]*)(</s>|\[/[A-Z_]+\])"


def read_back(text: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    of = lambda x, group: F.regexp_extract(x, TURN, group)
    role = lambda x: F.when(of(x, 4) == END, "assistant").when(of(x, 4) == "[/INST]", "user").when(of(x, 4) == "[/SYSTEM_PROMPT]", "system").otherwise(unescaped(of(x, 2)))
    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), lambda x: F.struct(role(x).alias("role"), unescaped(of(x, 3)).alias("text")))


def examples(conversations: DataFrame, keep_rest: bool = True) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text): conv_id, example, context, target.

    Turns go by turn (null first), then role and text; rows that are equal in all of these stay, each a turn. A null
    conv_id is a conversation. ``example`` counts from 0. With ``keep_rest`` the turns after the last reply, which no
    example holds, give one more row, with all turns as context and an empty target: nothing in it is trainable. A
    conversation without a reply has only that row. Further columns of the input aren't read. The last example of a
    conversation holds it whole, so an example's size is bounded by its conversation's alone.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", lambda t: formatted(t["role"], t["text"])).alias("parts"), F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("reply", i))
    rest = F.when(F.element_at("reply", -1), F.array().cast("array<int>")).otherwise(F.array(F.size("parts") + 1))
    rows = parts.select("conv_id", "parts", F.posexplode(F.concat(ends, rest) if keep_rest else ends).alias("example", "at"))
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.array_join(F.slice("parts", F.lit(1), F.col("at") - 1), "").alias("context"),
        F.coalesce(F.get("parts", F.col("at") - 1), F.lit("")).alias("target"),
    )


def with_mask(rows: DataFrame) -> DataFrame:
    """One text for each example, and the span [from, to) of its characters that is trained on."""
    return rows.select("conv_id", "example", F.concat("context", "target").alias("text"), F.length("context").cast("long").alias("loss_from"), (F.length("context") + F.length("target")).cast("long").alias("loss_to"))


def read_report(rows: DataFrame) -> DataFrame:
    """What the output of ``with_mask`` says of each conversation, read back from it.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn), loss_chars and loss_sha256 (of the
    unescaped replies under the mask, in order), formatted_chars (of all examples' texts).
    """
    masked = F.expr("substring(text, cast(loss_from AS int) + 1, cast(loss_to - loss_from AS int))")
    reply = F.transform(read_back(masked), lambda t: t["text"])
    one = rows.select("conv_id", "example", "text", F.array_join(reply, "").alias("reply"))
    byconv = one.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda e: e["reply"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    read = byconv.withColumn("turns", read_back(F.col("last")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
