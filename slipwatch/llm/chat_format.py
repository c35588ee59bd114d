"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role are
merged into a block by array operations; blocks are joined to one text:

    ### role: first text<part/>second text</turn>\\n

Control strings inside texts and roles are escaped with a backslash, so the text can be read
back exactly. The loss mask is a list of spans (start, end; characters) of the assistant's
texts in the formatted text.

Defined results: null text and null role count as empty; turns are ordered by turn (null
first), then role and text, so ties and repeated rows have one order; rows without conv_id
form one conversation. A conversation is one output row and must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and the letters that stand for them after a backslash.
HEAD, COLON, PART, TAIL = "### ", ": ", "<part/>", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("<part/>", "\\p"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))
LOSS_ROLE = "assistant"


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Pieces between doubled backslashes hold no other backslash than those of escapes."""

    def piece(x: Column) -> Column:
        for plain, coded in pairs[1:]:
            x = F.replace(x, F.lit(coded), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans) of (conv_id, turn, role, text); other columns are not used."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")))
    chats = rows.groupBy("conv_id").agg(sorted_turns.alias("_turns"))
    # Positions where another role begins, then the run of turns from each to the next.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("_turns")),
        lambda i: (i == 1) | (F.element_at("_turns", i)["role"] != F.element_at("_turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    chats = chats.withColumn("_starts", starts)
    run = lambda start, k: F.slice(
        "_turns", start, F.coalesce(F.get("_starts", k + 1), F.size("_turns") + 1) - start
    )
    blocks = F.transform(
        "_starts",
        lambda start, k: F.struct(
            F.element_at("_turns", start)["role"].alias("role"),
            F.transform(run(start, k), lambda t: escape(t["text"])).alias("parts"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("_blocks"))
    parts = F.transform(
        "_blocks",
        lambda b: F.struct(
            (b["role"] == loss_role).alias("loss"),
            F.concat(F.lit(HEAD), escape(b["role"], ROLE_ESCAPES), F.lit(COLON)).alias("head"),
            b["parts"].alias("parts"),
        ),
    )
    chats = chats.select("conv_id", parts.alias("_parts"))
    formatted = F.array_join(
        F.transform("_parts", lambda p: F.concat(p["head"], F.array_join(p["parts"], PART), F.lit(TAIL))), ""
    )
    # One span per assistant text: a fold over blocks that carries the position.
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start int, end int>>))")

    def block_spans(at: Column, p: Column) -> Column:
        none = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start int, end int>>))")
        return F.aggregate(
            p["parts"],
            none,
            lambda acc, t: F.struct(
                (acc["at"] + F.length(t) + len(PART)).alias("at"),
                F.array_append(
                    acc["spans"],
                    F.struct((at + acc["at"]).alias("start"), (at + acc["at"] + F.length(t)).alias("end")),
                ).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    spans = F.aggregate(
        "_parts",
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(F.array_join(p["parts"], PART)) + len(TAIL)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], block_spans(acc["at"] + F.length(p["head"]), p)))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds `turns`: the (role, text) structs in a formatted text, in order; other columns stay."""
    body = F.split(F.col(formatted), _quoted(TAIL), -1)
    blocks = F.slice(body, 1, F.size(body) - 1)

    def block(b: Column) -> Column:
        cut = F.locate(COLON, b)
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD)), ROLE_ESCAPES)
        texts = F.split(F.substring(b, cut + len(COLON), F.length(b)), _quoted(PART), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return chats.withColumn("turns", F.flatten(F.transform(blocks, block)))


def read_loss(chats: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Adds `loss_text`: what lies under the loss mask, unescaped; other columns stay."""
    text = F.col(formatted)
    return chats.withColumn(
        "loss_text",
        F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), ""),
    )
