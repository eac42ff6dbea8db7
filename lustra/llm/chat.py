"""Chat formatting: typed content parts flattened into one marked text per conversation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.session import stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Tokens that a placeholder stands for when its part does not tell.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
# An opening bracket, any backslashes, and the rest of a control string of ours or of a common template.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    """One backslash more inside every control string; undone by :func:`unescape`, whatever the text holds."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_REST}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_REST}", r"$1$2$3")


def visit(part: Column, sizes: Mapping[str, int] = EXPANDED) -> Column:
    """A part as struct: what it says, whether that is text, its reference and its expanded tokens.

    Image, audio and document parts become one placeholder named after their kind; any other kind, null
    included, is text, still without escapes, and a null text is empty.
    """
    kind = F.lower(part["kind"])
    held = F.coalesce(kind.isin(*sizes), F.lit(False))
    default = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in sizes.items()], F.lit(0))
    return F.struct(
        F.when(held, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.coalesce(part["text"], F.lit(""))).alias("out"),
        (~held).alias("is_text"),
        F.when(held, kind).alias("kind"),
        F.when(held, part["ref"]).alias("ref"),
        F.when(held, F.coalesce(part["tokens"], default.cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("tokens"),
    )


def flatten(parts: Column, sizes: Mapping[str, int] = EXPANDED) -> Column:
    """Parts as written: neighbouring texts joined and then escaped, so that no control string arises between two of them."""
    seen = F.transform(parts, lambda p: visit(p, sizes))
    text = lambda i: F.get(seen, i)["is_text"]
    every = F.when(F.size(seen) > 0, F.sequence(F.lit(0), F.size(seen) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(every, lambda i: (i == 0) | ~(text(i) & text(i - 1)))
    runs = F.transform(starts, lambda b, j: F.slice(seen, b + 1, F.coalesce(F.get(starts, j + 1), F.size(seen)) - b))

    def joined(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        out = F.when(first["is_text"], escape(F.array_join(F.transform(run, lambda p: p["out"]), ""))).otherwise(first["out"])
        return F.struct(out.alias("out"), *[first[c].alias(c) for c in ("is_text", "kind", "ref", "tokens")])

    return F.transform(runs, joined)


def format_chat(messages: DataFrame, sizes: Mapping[str, int] = EXPANDED, learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss, attachments, n_turns and expanded_tokens.

    ``messages`` has conv_id, turn, role and parts (an array as ``PARTS``); other columns are ignored.  Turns
    go by turn, nulls first, equal ones by role and written text.  A null role is empty, null or empty parts
    make an empty turn, rows with a null conv_id are one conversation, repeated rows are turns each, and no
    rows make no conversation.  ``loss`` lists (first, length) in code points of each run of text parts of
    ``learn`` turns; ``attachments`` lists kind, reference, code point of the placeholder and tokens, in order.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    given = messages.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("parts"), F.expr(f"CAST(array() AS {PARTS})")).alias("__parts"))
    turns = given.withColumn("parts", flatten(F.col("__parts"), sizes)).drop("__parts")
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    turns = turns.withColumn("body", F.expr("array_join(transform(parts, p -> p.out), '')"))
    turns = turns.withColumn("out", F.concat("head", "body", F.lit(END)))
    turns = turns.withColumn("length", F.expr("CAST(length(out) AS BIGINT)"))
    window = "PARTITION BY conv_id ORDER BY turn, role, out"
    turns = turns.withColumn("place", F.expr(f"row_number() OVER ({window})"))
    before = f"sum(length) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    turns = turns.withColumn("start", F.expr(f"coalesce({before}, 0) + length(head)"))
    # Where each part begins: the lengths of those before it in its turn.
    begin = "start + aggregate(slice(parts, 1, i), 0L, (n, q) -> n + length(q.out))"
    turns = turns.withColumn(
        "placed",
        F.expr(f"transform(parts, (p, i) -> struct({begin} AS first, CAST(length(p.out) AS BIGINT) AS length, p.is_text, p.kind, p.ref, p.tokens))"),
    )
    learned = f"if(role = '{learn}', filter(placed, p -> p.is_text), slice(placed, 1, 0))"
    turns = turns.withColumn("loss", F.expr(f"transform({learned}, p -> struct(p.first, p.length))"))
    held = "transform(filter(placed, p -> NOT p.is_text), p -> struct(p.kind, p.ref, p.first, p.tokens))"
    turns = turns.withColumn("attachments", F.expr(held))
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "out", "loss", "attachments"))).alias("turns"),
        F.expr("count(1) AS n_turns"),
    )
    return grouped.selectExpr(
        "conv_id",
        "array_join(transform(turns, t -> t.out), '') AS formatted",
        "flatten(transform(turns, t -> t.loss)) AS loss",
        "flatten(transform(turns, t -> t.attachments)) AS attachments",
        "n_turns",
        "aggregate(turns, 0L, (n, t) -> n + aggregate(t.attachments, 0L, (m, a) -> m + a.tokens)) AS expanded_tokens",
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Turns (role, text; placeholders stay) and the text under the loss mask, read back from formatted rows."""
    pieces = F.expr(r"filter(split(formatted, '<\\|turn\\|>', -1), (p, i) -> i > 0)")
    role = lambda p: unescape(F.substring_index(p, TEXT, 1))
    # A role cannot hold the text mark, nor a body the end mark, since both are escaped there.
    body = lambda p: unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["first"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"), "attachments", "expanded_tokens")


def text_messages(conversations: DataFrame, pieces: int = 1) -> DataFrame:
    """Plain conversation rows as messages of text parts; ``pieces`` cuts each text into so many of equal length."""
    kind = "ARRAY<STRUCT<kind: STRING, text: STRING, ref: STRING, tokens: BIGINT>>"
    text = "text" if pieces == 1 else f"substring(text, 1 + CAST(i * length(text) DIV {pieces} AS INT), CAST((i + 1) * length(text) DIV {pieces} - i * length(text) DIV {pieces} AS INT))"
    parts = f"CAST(transform(sequence(0, {pieces - 1}), i -> struct('text' AS kind, {text} AS text, NULL AS ref, NULL AS tokens)) AS {kind}) AS parts"
    return conversations.selectExpr("conv_id", "turn", "role", parts)


def written(formatted: DataFrame) -> DataFrame:
    """The formatted conversations as a table in the shared folder, read back."""
    return stage(formatted, "chat")
