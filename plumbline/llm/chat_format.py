r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged by an
array aggregation into one message; messages are concatenated into

    <|im_start|>role\ntext<|im_end|>\n

with ``<|im_sep|>`` between the turns of one message, so that the turns can be read back. A control string
inside a text is escaped by one more backslash after its ``<`` (``<|`` becomes ``<\|``, ``<\|`` becomes
``<\\|``), which ``unescape`` takes away again; a role has its backslashes and line ends escaped besides.
The loss mask holds the spans (code points, from 0) of the assistant's texts.

Edge cases: a null text is empty, a null role is the empty role, rows of one turn number are ordered by
role and text, repeated rows stay; a null conv_id is a conversation of its own; an empty table gives an
empty result. One conversation is one output row, so its turns meet in one task; that is the unit asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Split at escaped backslashes, from the left: what is left between them holds no other pair.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


#: Elements that are summed up, or spans that are cut out, at once; work grows with this and not with the turns.
BLOCK = 64


def _blocks(array: str) -> Column:
    """An array that is not empty, in slices of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, BLOCK))


def _running(values: Column) -> Column:
    """Sums up to each element of a short array."""
    grown = lambda s, v: F.concat(s, F.array(v + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long"))))
    return F.aggregate(values, F.expr("cast(array() as array<bigint>)"), grown)


def _with_ends(df: DataFrame, sizes: str) -> DataFrame:
    """``df`` with ends: the sum of ``sizes`` up to each element, by sums inside blocks and sums of blocks."""
    last = lambda b: F.element_at(b, -1)
    before = lambda c, i: F.coalesce(F.get(c, i - 1), F.lit(0).cast("long"))
    plus = lambda c, by: F.flatten(F.transform(c, lambda b, i: F.transform(b, lambda v: v + before(by, i))))
    df = df.withColumn("__inner", F.transform(_blocks(sizes), _running)).withColumn("__sums", F.transform("__inner", last))
    df = df.withColumn("__outer", F.transform(_blocks("__sums"), _running)).withColumn("__top", _running(F.transform("__outer", last)))
    df = df.withColumn("__upto", plus("__outer", "__top")).withColumn("ends", plus("__inner", "__upto"))
    return df.drop("__inner", "__sums", "__outer", "__top", "__upto")


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, messages (array of role, texts), formatted, loss_spans.

    A turn opens a message if the one before it in the sorted array has another role; messages are slices between
    such turns, so the work is in proportion to the turns.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    opens = lambda t, i: (i == 0) | (t["role"] != F.get("turns", i - 1)["role"])
    turns = turns.withColumn("opens", F.transform("turns", opens))
    turns = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("opens", i)))
    stop = lambda j: F.coalesce(F.get("starts", j + 1), F.size("turns"))
    messages = F.transform("starts", lambda s, j: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, stop(j) - s), lambda t: t["text"]).alias("texts")))
    head = lambda t, i: F.when(F.get("opens", i), F.char_length(t["role"]) + len(START) + 1 + F.when(i > 0, len(END) + 1).otherwise(0)).otherwise(len(SEP))
    turns = turns.withColumn("messages", messages).withColumn("sizes", F.transform("turns", lambda t, i: (head(t, i) + F.char_length(t["text"])).cast("long")))
    turns = _with_ends(turns, "sizes")
    said = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct((F.get("ends", i) - F.char_length(t["text"])).cast("int").alias("start"), F.get("ends", i).cast("int").alias("end"))))
    body = F.transform("messages", lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), F.array_join(m["texts"], SEP), F.lit(END + "\n")))
    return turns.select("conv_id", "messages", F.array_join(body, "").alias("formatted"), F.array_compact(said).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before merging and escaping."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b.startswith(START))
    inner = F.transform(blocks, lambda b: F.substring(b, len(START) + 1, 1 << 30))

    def turns(b: Column) -> Column:
        cut = F.instr(b, "\n")
        name = unescape_role(b.substr(F.lit(1), cut - 1))
        texts = F.split(b.substr(cut + 1, F.char_length(b)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(inner, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. A stretch of some spans is cut out first, as places are counted from the text's beginning."""
    cut = lambda whole, low, high: whole.substr(low + 1, high - low)

    def stretch(b: Column) -> Column:
        return F.transform(
            F.array(F.struct(cut(formatted, b[0]["start"], F.element_at(b, -1)["end"]).alias("text"), b[0]["start"].alias("from"), b.alias("spans"))),
            lambda x: F.array_join(F.transform(x["spans"], lambda s: unescape(cut(x["text"], s["start"] - x["from"], s["end"] - x["from"]))), ""),
        )[0]

    some = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: stretch(F.slice(spans, b * BLOCK + 1, BLOCK)))
    return F.when(F.size(spans) > 0, F.array_join(some, "")).otherwise(F.lit(""))
