"""Chat formatting by relational means: Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role merged into a message by an
aggregation over the array. Format:

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text[SEP]text</s>

with [SEP] between the turns merged into one message. Control strings inside texts and roles get a backslash after
their first character, one more than they have; reading takes one away, so every text comes back as it was.

All rows of a conversation meet once, in one exchange; all that follows is work within its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings. All begin with [ or <, which their other characters don't include.
BEGIN, ROLE, TEXT, NEXT, END = "<s>", "[INST]", "[/INST]", "[SEP]", "</s>"
_REST = r"(/?INST\]|SEP\]|/?s>)"

#: Items that a fold takes at once: each step copies what the fold holds.
PART = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def fold(items: str, kind: str, state: Callable[[Column], dict[str, Column]], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """An array of `kind`: what `step` gives for each item of the column `items` in order, besides the next state.

    Items are folded by parts of PART; state(i) is the state before the part that begins with item i. `at` of the state
    and `start` of what a step gives count from the part's beginning; parts are then put one behind another.
    """
    i = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(PART))
    empty = F.array().cast(f"array<{kind}>")

    def of(first: Column) -> Column:
        before = state(first)

        def go(a: Column, x: Column) -> Column:
            new, out = step(a, x)
            return F.struct(*(new[k].alias(k) for k in before), F.array_append(a["out"], out.cast(kind)).alias("out"))

        return F.aggregate(F.slice(items, first + 1, F.lit(PART)), F.struct(*(c.alias(k) for k, c in before.items()), empty.alias("out")), go)

    parts = F.transform(i, of)
    bases = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + p["at"]))
    names = [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
    moved = lambda p, base: F.transform(p["out"], lambda x: F.struct(*((x[n] + base if n == "start" else x[n]).alias(n) for n in names)))
    return F.flatten(F.zip_with(parts, F.slice(bases, F.lit(1), F.size(bases) - 1), moved))


def merged(turns: str) -> Column:
    """(control, text, start, loss) of a column of sorted, escaped turns (role, text), by an aggregation over the array.

    A turn of the role before goes on with its message: its control string is NEXT; others close a message and open one.
    start: the text's place in the formatted string, in code points; loss: whether the text is under the mask.
    """

    def step(a: Column, t: Column) -> tuple[dict[str, Column], Column]:
        opens = F.concat(F.when(a["role"].isNull(), F.lit(BEGIN)).otherwise(F.lit(END)), F.lit(ROLE), t["role"], F.lit(TEXT))
        control = F.when(a["role"] == t["role"], F.lit(NEXT)).otherwise(opens)
        start = a["at"] + F.length(control)
        out = F.struct(control.alias("control"), t["text"].alias("text"), start.alias("start"), (t["role"] == "assistant").alias("loss"))
        return {"role": t["role"], "at": start + F.length(t["text"])}, out

    before = lambda i: {"role": F.get(turns, i - 1)["role"], "at": F.lit(0)}
    return fold(turns, "struct<control:string,text:string,start:int,loss:boolean>", before, step)


def _key(start: Column, length: Column) -> Column:
    return start.cast("long") * (1 << 31) + length


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of conversations' (conv_id, turn, role, text): one row per conversation.

    loss: spans (start, length) in code points of the assistant's texts in `formatted`, in order. Turns are sorted by
    turn, then role and text; repeated rows stay. A null role or text counts as empty. A null conv_id is a conversation
    of its own. An empty table gives an empty one; other columns aren't looked at. A conversation is one row of the
    result, so its turns must fit into a row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    escaped = F.transform("t", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    pieces = rows.select("conv_id", escaped.alias("t")).select("conv_id", merged("t").alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["control"], x["text"])), ""), F.lit(END))
    loss = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), F.length(x["text"]).alias("length")))
    return pieces.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, turns, loss_text) from (conv_id, formatted, loss): turns (role, text) as they were put in.

    The formatted string is taken apart at its control strings; a text counts towards loss_text if its place in the
    string is a span of the mask.
    """
    messages = F.filter(F.split(F.substring("formatted", len(BEGIN) + 1, 2147483647), END, -1), lambda m: m != "")
    parted = F.transform(messages, lambda m: F.struct(F.substring_index(m, TEXT, 1).alias("head"), F.split(F.substring_index(m, TEXT, -1), r"\[SEP\]", -1).alias("texts")))
    lead = lambda m, i: F.when(i == 0, F.length(m["head"]) + len(TEXT)).otherwise(F.lit(len(NEXT)))
    after = lambda m, i: F.when(i == F.size(m["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0))
    texts = F.flatten(F.transform(parted, lambda m: F.transform(m["texts"], lambda x, i: F.struct(m["head"].alias("head"), x.alias("raw"), lead(m, i).alias("before"), after(m, i).alias("after")))))

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = a["at"] + x["before"]
        return {"at": start + F.length(x["raw"]) + x["after"]}, F.struct(x["head"].alias("head"), x["raw"].alias("raw"), start.alias("start"))

    read = rows.select("conv_id", F.length("formatted").alias("chars"), F.transform("loss", lambda s: _key(s["start"], s["length"])).alias("mask"), texts.alias("x"))
    at = lambda i: {"at": F.when(i == 0, F.lit(len(BEGIN))).otherwise(F.lit(0))}
    placed = read.select("conv_id", "chars", "mask", fold("x", "struct<head:string,raw:string,start:int>", at, step).alias("t"))
    role = lambda t: unescape(F.replace(t["head"], F.lit(ROLE), F.lit("")))
    # Spans and turns by their place in one sorted array: a turn under the mask stands right behind its span.
    met = F.array_sort(F.concat(F.transform("mask", lambda k: 2 * k), F.transform("t", lambda t: 2 * _key(t["start"], F.length(t["raw"])) + 1)))
    sorted_ = placed.select("conv_id", "chars", "t", met.alias("met"))
    on = F.transform(F.filter(F.transform("met", lambda k, i: F.struct(k.alias("k"), (F.get("met", i - 1) == k - 1).alias("on"))), lambda x: x["k"] % 2 == 1), lambda x: F.coalesce(x["on"], F.lit(False)))
    turns = F.zip_with("t", on, lambda t, m: F.struct(role(t).alias("role"), unescape(t["raw"]).alias("text"), m.alias("on")))
    back = sorted_.select("conv_id", F.col("chars").cast("long").alias("formatted_chars"), turns.alias("turns"))
    return back.select("conv_id", "formatted_chars", "turns", F.array_join(F.transform(F.filter("turns", lambda t: t["on"]), lambda t: t["text"]), "").alias("loss_text"))


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, as counts and SHA-256 digests."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted(conversations)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
