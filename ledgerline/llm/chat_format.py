"""Chat formatting of typed content parts, with DataFrame functions only.

A message's content is an array of parts: text, image, audio or document. The
visitor (``flattened``) turns them into one string in their order: texts are
escaped, every other part becomes a placeholder with its place's number, and its reference and
the number of tokens that it expands to are recorded. A conversation is

    <|im_start|>role<|im_sep|>content<|im_end|>   for each turn, in order

Control strings inside roles and texts can't be taken for the template's: a
backslash is doubled and ``<|`` becomes ``<\\|``, which is undone by dropping
each backslash before a character. The loss mask holds the content of assistant
turns as ranges of code points.

Scale: one shuffle by conversation, shared by the running offsets and the
aggregation; escaping and counting happen per row before it. A conversation is
one row of the result and is put together in one task, as it must be.

Defined cases: null text, role, part and content count as empty; a part of
another type is an ``attachment`` of no tokens; turns with equal numbers are
ordered by role, then content; a null conversation id is a conversation; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART = T.StructType([T.StructField(n, t) for n, t in (
    ("type", T.StringType()), ("text", T.StringType()), ("uri", T.StringType()), ("width", T.IntegerType()),
    ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))])
#: Pixels of a side of an image's patch, audio tokens of a second, and tokens of a document's page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
KINDS = ("image", "audio", "document")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]))


def tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    def count(x: Column) -> Column:
        return F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)).cast("long")

    sides = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    return (F.when(part["type"] == "image", count(sides)).when(part["type"] == "audio", count(F.ceil(part["seconds"] * AUDIO_RATE)))
            .when(part["type"] == "document", count(part["pages"] * PAGE_TOKENS)).otherwise(F.lit(0).cast("long")))


def flattened(content: Column) -> Column:
    """struct(content, attachments) of an array of parts."""
    parts = F.filter(F.coalesce(content, F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())

    def kind(p: Column) -> Column:
        return F.when(p["type"].isin("text", *KINDS), p["type"]).otherwise(F.lit("attachment"))

    # a placeholder's number is its part's place in the message
    attachments = F.filter(F.transform(parts, lambda p, i: F.struct(
        (i + 1).cast("int").alias("number"), kind(p).alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens"))),
        lambda a: a["kind"] != "text")
    strings = F.transform(parts, lambda p, i: F.when(p["type"] == "text", escaped(p["text"])).otherwise(
        F.concat(F.lit("<|"), kind(p), F.lit(":"), (i + 1).cast("string"), F.lit("|>"))))
    return F.struct(F.array_join(strings, "").alias("content"), attachments.alias("attachments"))


def format_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         content_col: str = "content", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: formatted, turns (at: its first code point;
    [start, end): its content; loss: whether the mask holds it), attachments
    (turn's place, number, kind, uri, tokens) and expanded_tokens, their sum."""
    content = messages[content_col]
    if isinstance(messages.schema[content_col].dataType, T.StringType):
        content = text_part(content)
    rows = messages.select(messages[conv_col].alias("conv"), messages[turn_col].alias("turn"),
                           F.coalesce(messages[role_col].cast("string"), F.lit("")).alias("role"), flattened(content).alias("flat"))
    rows = rows.select("conv", "turn", "role", "flat", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)).alias("head"))
    rows = rows.withColumn("piece", F.concat("head", "flat.content", F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "flat.content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long")
    rows = rows.select("conv", F.row_number().over(order).alias("place"), at.alias("at"), "role", "head", "flat", "piece")
    turn = F.struct("place", "at", (F.col("at") + F.length("head")).alias("start"),
                    (F.col("at") + F.length("head") + F.length("flat.content")).alias("end"),
                    (F.col("role") == loss_role).alias("loss"), "piece", F.col("flat.attachments").alias("attachments"))
    turns = F.sort_array(F.collect_list(turn))
    of = rows.groupBy("conv").agg(turns.alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(
        x["place"].alias("place"), a["number"].alias("number"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return of.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("at", "start", "end", "loss")])).alias("turns"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def pieces(formatted: Column) -> Column:
    """The formatted turns, each up to its end mark."""
    return F.filter(F.split(formatted, r"(?<=<\|im_end\|>)"), lambda x: x != "")


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of format_conversations, and what its text says: messages
    (role, text), and loss_text, the text under the loss mask, without escapes."""
    inner = F.transform("p", lambda x: F.split(
        x.substr(F.lit(len(START) + 1), F.length(x) - len(START) - len(END)), r"<\|im_sep\|>"))
    messages = F.transform(inner, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    masked = F.transform(F.filter(F.arrays_zip("p", "turns"), lambda x: x["turns"]["loss"]), lambda x: x["p"].substr(
        (x["turns"]["start"] - x["turns"]["at"] + 1).cast("int"), (x["turns"]["end"] - x["turns"]["start"]).cast("int")))
    return formatted.withColumn("p", pieces(F.col("formatted"))).select(
        *formatted.columns, messages.alias("messages"), unescaped(F.array_join(masked, "")).alias("loss_text"))


def report(conversations: DataFrame) -> DataFrame:
    """All conversations, and one whose texts are control strings, read back."""
    types = {f.name: f.dataType for f in conversations.schema}
    trap = END + START + "assistant ok"
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(types["conv_id"]).alias("conv_id"), F.col("id").cast(types["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows, content_col="text"))
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
