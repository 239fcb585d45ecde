"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is an ordered array of typed parts: text, image, audio or document.
A visitor (one ``transform`` over the parts, in their order) flattens them: text
is escaped and kept; an attachment becomes a numbered placeholder, its reference
goes to ``attachments`` together with the number of tokens that the placeholder
expands to (see ``expanded_tokens``).

The template puts each turn between control strings::

    <turn>ROLE\\nTEXT</turn>\\n        and  <image:1/>  <audio:2/>  <document:3/>

Control strings all begin with ``<``, which escaped text never contains: in
texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (roles also turn a line
feed into ``\\n``).  After escaping, every backslash is followed by one of these
letters, so replacing ``\\l`` and then ``\\b`` gives the text back.

A conversation becomes one row: ``formatted``, the same string cut into
``segments`` with the loss mask (the content of assistant turns is trained on,
everything else is not), and the attachments.  Turns are gathered by one shuffle
on the conversation; the row is the result asked for, so its size is that of
one conversation.

Defined results: a null text or part list is an empty message, a null role is
empty and never trained on; turns are ordered by (turn, role, text), nulls
first; rows without conversation id are one conversation; an empty table gives
no conversation; a part of an unknown type is kept as a placeholder of no
tokens; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED = "assistant"
#: Tokens: one for each started square of this side; for each started second;
#: for each page.
IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 800

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,"
        "seconds:double,pages:int>")
OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain message as a part list."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"),
        none.cast("int").alias("width"), none.cast("int").alias("height"),
        none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def expanded_tokens(part: Column) -> Column:
    """How many tokens a placeholder stands for; unknown sizes count as none."""
    def patches(side: str) -> Column:
        return F.ceil(F.greatest(part[side], F.lit(0)) / IMAGE_PATCH)

    size = (F.when(part["type"] == "image", patches("width") * patches("height"))
            .when(part["type"] == "audio",
                  F.ceil(F.greatest(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
            .when(part["type"] == "document",
                  F.greatest(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_PER_PAGE))
    return F.coalesce(size, F.lit(0)).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text",
                 parts_col: str | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss), attachments (number,
    turn, type, ref, tokens).

    ``parts_col`` names an array of ``PART`` structs; without it ``text_col`` is
    one text part.
    """
    col = {c: F.col(f"`{c}`") for c in (conv_col, turn_col, role_col)}
    parts = (F.col(f"`{parts_col}`").cast(f"array<{PART}>") if parts_col
             else text_parts(F.col(f"`{text_col}`").cast("string")))
    rows = messages.select(
        col[conv_col].cast("long").alias("conv_id"),
        F.struct(col[turn_col].cast("long").alias("turn"),
                 F.coalesce(col[role_col].cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.filter(parts, lambda p: p.isNotNull()),
                            F.array().cast(f"array<{PART}>")).alias("parts")).alias("m"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    # Numbers of attachments: a running count over the turns, then in each turn.
    files = F.transform("m", lambda m: F.filter(m["parts"], lambda p: ~is_text(p)))
    counted = turns.withColumn("files", files).withColumn("n", F.transform("files", F.size))
    before = F.aggregate(
        "n", F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s")),
        lambda acc, n: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"),
                                (acc["s"] + n).alias("s")),
        lambda acc: acc["a"])
    # Without any attachment no running count is needed.
    numbered = counted.withColumn(
        "before", F.when(F.exists("n", lambda n: n > 0), before)
        .otherwise(F.array_repeat(F.lit(0), F.size("n"))))

    def placeholder(kind: Column, number: Column) -> Column:
        return F.concat(F.lit("<"), escaped_role(kind), F.lit(":"), number.cast("string"),
                        F.lit("/>"))

    def visit(m: Column, start: Column) -> Column:
        kinds = m["parts"]
        pieces = F.transform(kinds, lambda p, i: F.when(
            is_text(p), escaped(F.coalesce(p["text"], F.lit(""))))
            .otherwise(placeholder(p["type"], start + 1 + F.size(
                F.filter(F.slice(kinds, 1, i), lambda q: ~is_text(q))))))
        return F.array_join(pieces, "")

    bodies = F.transform(F.arrays_zip("m", "before"), lambda z: F.struct(
        F.concat(F.lit(OPEN), escaped_role(z["m"]["role"]), F.lit("\n")).alias("head"),
        visit(z["m"], z["before"]).alias("body"),
        (z["m"]["role"] == TRAINED).alias("loss")))
    segments = F.flatten(F.transform("bodies", lambda b: F.array(
        F.struct(b["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(b["body"].alias("text"), b["loss"].alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    attachments = F.flatten(F.transform(
        F.arrays_zip("m", "files", "before"), lambda z: F.transform(
            z["files"], lambda p, i: F.struct(
                (z["before"] + i + 1).alias("number"), z["m"]["turn"].alias("turn"),
                p["type"].alias("type"), p["ref"].alias("ref"),
                expanded_tokens(p).alias("tokens")))))
    return (numbered.withColumn("bodies", bodies).withColumn("segments", segments)
            .select("conv_id", F.size("m").cast("long").alias("n_turns"),
                    F.array_join(F.col("segments.text"), "").alias("formatted"),
                    "segments", attachments.alias("attachments")))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        unescaped_role(F.substring_index(F.substring(b, len(OPEN) + 1, 1 << 30), "\n", 1)
                       ).alias("role"),
        unescaped(F.substring(b, F.locate("\n", b, len(OPEN) + 1) + 1, F.lit(1 << 30))
                  ).alias("text")))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescaped(s["text"])), "")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like the control strings."""
    text = "\\### Assistant: </turn> ok"
    rows = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"),
                              F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                              F.lit(text).alias("text"))
                     for i, r in enumerate(("user", TRAINED))])
    return spark.range(1).select(F.inline(rows))


def report(formatted: DataFrame) -> DataFrame:
    """Counts and digests, read back from the formatted conversations."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"),
                            read_loss(F.col("segments")).alias("loss"))
    lines = F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
