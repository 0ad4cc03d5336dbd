"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only that
reply is trainable. Turns after the last reply, or a conversation without one, come as a last example
with nothing trainable, so that the examples hold every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """A backslash goes before each backslash and inside each `<|`, so no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example, n_turns, formatted, loss_start, loss_chars.

    formatted[loss_start, loss_start + loss_chars) is the trainable reply (escaped, in code points);
    loss_chars is 0 in an example without a reply, and may be 0 for an empty reply, told apart by `trains`.
    Turns are ordered by turn, then role and text; repeated rows stay; a null role or text is empty; rows
    without a conv_id are one conversation. Other columns are not read. A conversation is one row in memory.
    """
    none = F.lit("")
    said = turns.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    told = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    told = told.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), head(x).alias("head"), escape(x["text"]).alias("body"))).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (F.element_at("t", i)["role"] == "assistant") | (i == F.size("t")))
    each = told.select("conv_id", "t", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("t", F.col("n_turns"))
    each = each.select(
        "conv_id", "example", "n_turns", last.alias("last"), (last["role"] == "assistant").alias("trains"),
        F.array_join(F.transform(F.slice("t", F.lit(1), F.col("n_turns") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("context"),
    )
    return each.select(
        "conv_id",
        "example",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("context", "last.head", "last.body", F.lit(CLOSE)).alias("formatted"),
        (F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("trains"), F.length("last.body")).otherwise(0).cast("long").alias("loss_chars"),
        "trains",
    )


def turns_of(formatted: Column) -> Column:
    """Read a formatted example back: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    split = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"  # possessive: no recursion, however long a role is
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, split, 1)).alias("role"), unescape(F.regexp_extract(p, split, 2)).alias("text")),
    )


def trained_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The reply under the loss mask, unescaped."""
    return unescape(F.substring(formatted, loss_start.cast("int") + 1, loss_chars.cast("int")))


def digests(made: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text."""
    read = made.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("trains"), trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).alias("reply"))
    each = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    each = each.withColumn("turns", turns_of(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return each.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
