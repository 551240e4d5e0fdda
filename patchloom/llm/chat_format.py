"""Chat formatting by a grammar round trip (DataFrame functions only).

Grammar of the output, one conversation a string::

    conversation := turn*
    turn         := "<|turn|>" role "<|text|>" text "<|end|>"

Roles and texts hold no "<|" once escaped, so the parser is deterministic: split at "<|turn|>", then at
"<|text|>", then cut "<|end|>". A control string is an opener ("<" or "["), any number of backslashes and
one of the closers below; escaping adds a backslash after the opener and unescaping takes one away, so
texts that already hold escaped strings survive too. No closer holds an opener: matches never overlap.

The round trip: a conversation is rendered as it is, parsed, and compared with its source. Where that
differs, or where the parser meets a bare control string inside a text, the turns that do not survive alone are
escaped and the whole is tried again, and then all turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of this grammar, and control strings of common chat templates that texts may not hold bare.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
OPENERS = r"<|\["
CLOSERS = r"\||/?s>|/?INST\]|/?SYS>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})(\\*)({CLOSERS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\(\\*)({CLOSERS})", r"$1$2$3")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw, chars>> of a formatted string; raw is the text as it stands in the output, chars
    what stands before it in its turn. A turn without an end has no text: null."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0)

    def turn(piece):
        parts = F.split(piece, r"<\|text\|>")
        rest = F.array_join(F.slice(parts, 2, 1 << 30), TEXT)
        raw = F.when(F.endswith(rest, F.lit(END)), F.regexp_replace(rest, r"<\|end\|>\z", ""))
        return F.struct(unescape(parts[0]).alias("role"), unescape(raw).alias("text"), raw.alias("raw"), (F.length(parts[0]) + len(TURN) + len(TEXT)).alias("chars"))

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted, parsed (what the parser reads back), escaped_turns.

    Rows go by turn; ties by role and text, nulls first, repeated rows stay. A null role or text is empty; a null
    conv_id is a conversation of its own; a null turn comes first. An empty table gives no row. Only the four named
    columns are read. One conversation is one output string, so a group is as large as its own result; turns are
    escaped and tried before the shuffle, and only strings meet there.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END))
    alone = parse(plain)
    survives = (F.size(alone) == 1) & alone[0]["text"].isNotNull() & (alone[0]["role"] == role) & (alone[0]["text"] == text) & (escape(text) == text) & (escape(role) == role)
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), survives.alias("survives")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def render(as_escaped):
        return F.array_join(
            F.transform(
                "ts",
                lambda t: F.concat(
                    F.lit(TURN),
                    F.when(as_escaped(t), escape(t["role"])).otherwise(t["role"]),
                    F.lit(TEXT),
                    F.when(as_escaped(t), escape(t["text"])).otherwise(t["text"]),
                    F.lit(END),
                ),
            ),
            "",
        )

    def same(parsed):
        # a bare control string inside a text is an error of the grammar, whichever template it belongs to
        no_bare = F.forall(F.col(parsed), lambda t: F.coalesce(~t["raw"].rlike(rf"({OPENERS})({CLOSERS})"), F.lit(False)))
        bare = lambda x: F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return no_bare & bare(F.col(parsed)).eqNullSafe(bare(F.col("ts")))

    tried = whole.withColumn("formatted", render(lambda t: F.lit(False))).withColumn("parsed", parse(F.col("formatted")))
    for as_escaped in (lambda t: ~t["survives"], lambda t: F.lit(True)):
        tried = tried.withColumn("formatted", F.when(same("parsed"), F.col("formatted")).otherwise(render(as_escaped)))
        tried = tried.withColumn("parsed", parse(F.col("formatted")))
    # with every string escaped no text can end a turn; should it ever differ, nothing is put out
    broken = F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    tried = tried.withColumn("formatted", F.when(same("parsed"), F.col("formatted")).otherwise(broken.cast("string")))
    escaped = F.size(F.filter("parsed", lambda t: t["raw"] != t["text"])).cast("long")
    return tried.select("conv_id", "formatted", "parsed", escaped.alias("escaped_turns"))


def loss_mask(formatted: DataFrame) -> DataFrame:
    """conv_id, start, end: where the texts of the assistant stand in formatted, in code points; a row for each."""
    turns = formatted.select("conv_id", F.posexplode("parsed").alias("turn", "t"))
    size = F.col("t.chars") + F.length("t.raw") + len(END)
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.col("t.chars")
    spans = turns.select("conv_id", "t.role", start.alias("start"), (start + F.length("t.raw")).alias("end"))
    return spans.where("role = 'assistant'").select("conv_id", "start", "end")


def digests(formatted: DataFrame) -> DataFrame:
    """The columns of the query contract. Turns are what the parser reads back; the loss text is cut from `formatted`: of
    each turn's string what stands under the mask, which goes from its first `chars` on over the length of its text, is
    unescaped and joined."""
    strings = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p, i: i > 0)
    under = lambda p, t: F.substring(p, t["chars"] - len(TURN) + 1, F.length(t["raw"]))
    masked = F.zip_with(strings, "parsed", lambda p, t: F.when(t["role"] == "assistant", unescape(under(p, t))))
    loss = F.array_join(masked, "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped_turns",
    )
