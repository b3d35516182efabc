"""Chat formatting with typed content parts, in built-in functions only.

A turn is ``### role: text</turn>`` and a line end. Inside texts and roles the
backslash is doubled and each control string is broken by a backslash, so the
bare markers occur nowhere else. A conversation is one text with a loss mask;
reading back cuts that text at its bare markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Turns gathered at once before whole conversations are put together.
CHUNK = 64
#: Tokens that one attachment of a kind takes up.
PART_TOKENS = {"image": 576, "audio": 1500, "document": 1024}
PART_TYPE = "array<struct<kind:string,text:string,ref:string>>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("</turn>"), F.lit("<\\/turn>"))
    c = F.replace(c, F.lit("### "), F.lit("##\\# "))
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def visit_parts(parts: Column) -> Column:
    """Flatten typed parts, in order, into text, attachments and expanded tokens.

    Texts are escaped; an image, audio or document part becomes the placeholder
    ``<|kind:n|>``, n counting the attachments from 0. A part of another kind is an
    attachment of no tokens. Null parts and null texts are empty.
    """
    clean = F.filter(parts, lambda p: p.isNotNull())
    attached = F.filter(clean, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")

    def shown(p: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(clean, 1, i), lambda q: F.coalesce(q["kind"], F.lit("text")) != "text"))
        return (
            F.when(F.coalesce(p["kind"], F.lit("text")) == "text", escape(F.coalesce(p["text"], F.lit(""))))
            .otherwise(F.concat(F.lit("<|"), escape(p["kind"]), F.lit(":"), n.cast("string"), F.lit("|>")))
        )

    def tokens(kind: str) -> Column:
        return F.size(F.filter(attached, lambda p: p["kind"] == kind)) * PART_TOKENS[kind]

    cost = F.lit(0)
    for kind in PART_TOKENS:
        cost = cost + tokens(kind)
    return F.struct(
        F.array_join(F.transform(clean, shown), "").alias("text"),
        F.transform(attached, lambda p, i: F.struct(i.alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"))).alias("attachments"),
        F.coalesce(cost, F.lit(0)).cast("bigint").alias("attachment_tokens"),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, parts) turn by turn.

    Returns conv_id, turn, formatted, loss_start and loss_len (code points in
    ``formatted``; length 0 unless the role is assistant), attachments and
    attachment_tokens. A conversation's text is its turns' in order.
    """
    v = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit_parts(F.col("parts")).alias("v"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(COLON), F.lit(":\\ ")), F.lit(COLON))
    return v.select("conv_id", "turn", head.alias("head"), "role", "v").select(
        "conv_id", "turn", F.concat("head", F.coalesce("v.text", F.lit("")), F.lit(CLOSE)).alias("formatted"),
        F.length("head").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length("v.text")).otherwise(0).alias("loss_len"),
        "v.attachments", "v.attachment_tokens",
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, text and mask of every conversation: its turns in order, and what is under the loss.

    Turns are ordered by turn (null first), then role marker and text. The mask has an
    entry for every turn: start within the turn and length, length 0 where no loss falls. Turns
    are put together CHUNK turn numbers at a time, then by conversation.
    """
    row = F.struct("turn", "formatted", "loss_start", "loss_len")
    part = (
        formatted.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select("conv_id", F.struct(
            "chunk", F.array_join(F.col("rows.formatted"), "").alias("text"),
            F.transform("rows", lambda r: F.struct(r["loss_start"].alias("start"), r["loss_len"].alias("len"))).alias("mask")).alias("part"))
    )
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.array_join(F.col("parts.text"), "").alias("text"), F.flatten("parts.mask").alias("mask"))


def read_back(whole: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (role and text) and loss (the text under the mask, turn by turn) of conversations.

    Roles and texts come from the conversation's text alone, which is cut at its bare markers.
    """
    pieces = F.split("text", CLOSE)
    cut = whole.select("conv_id", F.length("text").cast("bigint").alias("formatted_chars"), F.slice(pieces, 1, F.size(pieces) - 1).alias("cut"), "mask")

    def turn(t: Column) -> Column:
        colon = F.instr(t, COLON)
        return F.struct(
            unescape(F.substring(t, F.lit(len(OPEN) + 1), colon - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(t, colon + len(COLON), F.length(t))).alias("text"))

    masked = F.zip_with("cut", "mask", lambda t, m: F.coalesce(unescape(F.substring(t, m["start"] + 1, m["len"])), F.lit("")))
    return cut.select("conv_id", "formatted_chars", F.transform("cut", turn).alias("turns"), masked.alias("loss"))


def digest(read: DataFrame) -> DataFrame:
    """Per conversation: turn count, length of the formatted text, and the digests of its turns and of its loss text."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.array_join("loss", "").alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
