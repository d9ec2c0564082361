"""Chat formatting with Spark expressions only.

Rows of one conversation become one sorted array of turn structs; a turn
whose role equals its predecessor's joins the predecessor's block, and the
blocks are concatenated.  The template is

    <|im_start|>role \\n text [<|im_next|> text ...] <|im_end|> \\n

``<|im_next|>`` parts the texts of adjacent same-role turns inside a block,
so the original turns can be read back.  Inside roles and texts, a backslash
is doubled and ``<|`` becomes ``<\\|`` (a newline in a role ``<\\n>``), so no
text can hold a control string; reading reverses this exactly.

The loss mask is run-length coded: ``mask`` is an array of (chars, in_loss)
whose runs tile the formatted text; assistant texts are in the loss, markers
and the other roles are not.

Defined cases: null text is empty, null role is the empty role, a null
conv_id is a conversation of its own, turns with equal numbers are ordered by
role then text (null turn numbers first), repeated rows are turns of their
own, extra columns are ignored, no rows give no rows.  A conversation is one
output row, so its own text has to fit in a task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_BS = "\\"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_BS), F.lit(_BS * 2)), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit(_BS * 2), F.lit(_BS))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n>"), F.lit("\n")))


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row per conversation with
    ``formatted`` and ``mask`` (array of (chars, in_loss) runs)."""
    src = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        ts = F.col("ts")
        first = (i == 0) | (F.get(ts, i - 1)["role"] != t["role"])
        last = (i == F.size(ts) - 1) | (F.get(ts, i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(NEXT))
        return F.struct(
            head.alias("head"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
            (t["role"] == LOSS_ROLE).alias("in_loss"),
        )

    pieces = turns.select("conv_id", F.transform("ts", piece).alias("p"))
    mask = F.flatten(
        F.transform(
            "p",
            lambda x: F.array(
                F.struct(F.char_length(x["head"]).alias("chars"), F.lit(False).alias("in_loss")),
                F.struct(F.char_length(x["body"]).alias("chars"), x["in_loss"].alias("in_loss")),
                F.struct(F.char_length(x["tail"]).alias("chars"), F.lit(False).alias("in_loss")),
            ),
        )
    )
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    return pieces.select("conv_id", whole.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` by its control strings: adds ``turns``, the array
    of original (role, text) turns in order."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        nl = F.locate("\n", b)
        body = F.substring(b, nl + 1, F.char_length(b) - nl - len(END) - 1)
        r = _unescape_role(F.substring(b, F.lit(1), nl - 1))
        return F.transform(
            F.split(body, r"<\|im_next\|>"), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))
        )

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def masked_text(formatted: str = "formatted", mask: str = "mask") -> Column:
    """All text under the loss mask, unescaped: the formatted text is cut at
    the mask's runs, one after the other."""

    def cut(a: Column, run: Column) -> Column:
        piece, rest = F.substring(a["rest"], F.lit(1), run["chars"]), F.substring(a["rest"], run["chars"] + 1, F.char_length(a["rest"]))
        return F.struct(rest.alias("rest"), F.when(run["in_loss"], F.concat(a["loss"], unescape(piece))).otherwise(a["loss"]).alias("loss"))

    return F.aggregate(mask, F.struct(F.col(formatted).alias("rest"), F.lit("").alias("loss")), cut)["loss"]


def digest(formatted: DataFrame) -> DataFrame:
    """The figures of a formatted table: turns from what :func:`read_back`
    reads, the loss from what lies under the mask."""
    back = read_back(formatted).withColumn("_loss", masked_text())
    loss = F.col("_loss")
    flat = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    masked = F.aggregate("mask", F.lit(0), lambda a, m: a + F.when(m["in_loss"], m["chars"]).otherwise(0))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        masked.cast("long").alias("mask_chars"),
    )
