"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Escapes, applied in this order and undone in reverse. After the first, a backslash is always followed by s, so the
#: others stay unambiguous; an escaped text holds neither control string.
TEXT_ESCAPES = (("\\", "\\s"), ("</turn>", "\\e"), ("### ", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def _escape(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in rules:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(rules):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand_prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trainable: str = "assistant") -> DataFrame:
    """One example for every trainable turn: all turns before it as context, and only its text under the loss mask.

    A turn is written as ``### role: text</turn>\\n``; control strings inside roles and texts are escaped reversibly.
    Turns after the last trainable one, or a conversation without any, give one more example with an empty mask, so that
    nothing is lost. Returns conv_id, example (1, 2, ...), formatted, loss_start and loss_chars (code points).

    One conversation is one record here, as it is in training: its turns meet in one row, after one shuffle by its id. The
    expansion itself is the product of turns and replies, which is what the format asks for; each example is a row of its own.
    Null roles and texts count as empty; rows with a null id form one conversation with a null id; turns come in the order
    (turn, role, text) with nulls first, and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    parts = F.transform(
        F.sort_array(F.collect_list("t")),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _escape(t["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"),
            _escape(t["text"], TEXT_ESCAPES).alias("body"),
            (t["role"] == trainable).alias("learn"),
        ),
    )
    conversations = rows.groupBy("conv_id").agg(parts.alias("parts"))
    lines = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))
    replies = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["learn"])
    rest = F.when(~F.element_at("parts", -1)["learn"], F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    sizes = F.transform("parts", lambda p: F.length(p["body"]))
    # one row for each example before its text is made, so that a row never holds more than one example
    wanted = conversations.select("conv_id", lines.alias("lines"), sizes.alias("sizes"), F.concat(replies, rest).alias("ends"))
    each = wanted.select("conv_id", "lines", "sizes", F.posexplode("ends").alias("k", "end"))
    out = each.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        F.array_join(F.when(F.col("end") == 0, F.col("lines")).otherwise(F.slice("lines", F.lit(1), F.col("end"))), "").alias("formatted"),
        F.when(F.col("end") == 0, F.lit(0)).otherwise(F.get("sizes", F.col("end") - 1)).alias("loss_chars"),
    )
    # the mask ends where the closing mark of the last turn begins
    start = F.length("formatted") - F.lit(len(CLOSE)) - F.col("loss_chars")
    return out.select("conv_id", "example", "formatted", start.alias("loss_start"), "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: its turns and the texts under the mask, unescaped, from the output alone.

    Returns conv_id, turns (array of role and text), losses (array of texts in order) and formatted_chars (of all examples).
    """
    masked = F.expr("substring(formatted, loss_start + 1, loss_chars)")
    per = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).alias("last"),
        F.sort_array(F.collect_list(F.struct("example", masked.alias("text")))).alias("masked"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    pieces = F.split(F.col("last.formatted"), CLOSE, -1)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            _unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ": ", 1), ROLE_ESCAPES).alias("role"),
            _unescape(F.substr(p, F.length(F.substring_index(p, ": ", 1)) + 3), TEXT_ESCAPES).alias("text"),
        ),
    )
    return per.select("conv_id", turns.alias("turns"), F.transform("masked", lambda m: _unescape(m["text"], TEXT_ESCAPES)).alias("losses"), "formatted_chars")


def digest(examples: DataFrame) -> DataFrame:
    """Digests of what can be read back from the examples, one row for each conversation."""
    back = read_back(examples)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )
