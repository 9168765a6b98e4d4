"""Chat formatting of typed content parts, in DataFrame expressions only.

A turn's content is an array of parts (``PARTS``). A visitor goes through them in order: text is escaped, every other part leaves
a placeholder and a record of its reference and of the tokens that it will be expanded to:

* image: ``ceil(width / 14) * ceil(height / 14)`` tokens,
* audio: ``ceil(seconds * 25)`` tokens,
* document: ``pages * 1024`` tokens,
* anything else (placeholder ``file``): none.

A turn is ``<|turn|>role<|text|>body<|end|>``, a conversation its turns in order. Within role and text a backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string, and both are undone when read. The loss mask is the text of
the assistant's turns, a span for each text part, as code points within the turn.

Formatting a turn is a projection; one shuffle brings the turns of a conversation together, a conversation being one training
example and so one row. Positions are kept within turns, so nothing is summed over long arrays.

Edge cases: null text is empty text, a null role is an empty one; null content has no parts, null parts are skipped, missing
sizes count 0 tokens; turns with the same number are ordered by role, then by content; rows with null turn come first; a null
conv_id is a conversation of its own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
MEDIA = ["image", "audio", "document"]
OTHER = "file"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 1024
LOSS_ROLE = "assistant"
_SPANS = "array<struct<start:int,length:int>>"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def placeholder(kind: str) -> str:
    return f"<|{kind}|>"


def text_parts(text: Column) -> Column:
    """Plain text as content of one part."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")]]
    return F.array(F.struct(*fields)).cast(PARTS)


def visit(part: Column) -> Column:
    """What a part becomes: its string in the body, whether that is text, its reference and its tokens."""
    is_text = part["kind"] == "text"
    kind = F.when(part["kind"].isin(*MEDIA), part["kind"]).otherwise(F.lit(OTHER))
    tokens = (
        F.when(kind == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(kind == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(kind == "document", part["pages"] * PAGE_TOKENS)
    )
    body = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
    return F.struct(body.alias("body"), F.coalesce(is_text, F.lit(False)).alias("is_text"), kind.alias("kind"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def _spans(seen: Column, offset: Column) -> Column:
    """Spans of the text parts, if the first part begins at ``offset``."""
    start = F.struct(offset.alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s, x):
        span = F.struct(s["at"].alias("start"), F.length(x["body"]).alias("length"))
        return F.struct((s["at"] + F.length(x["body"])).alias("at"), F.when(x["is_text"], F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(seen, start, step, lambda s: s["out"])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the formatted turn of rows (conv_id, turn, role, content): a projection."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(F.coalesce("content", F.array().cast(PARTS)), lambda p: p.isNotNull()).alias("content"))
    seen = plain.select("conv_id", "turn", "role", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), F.transform("content", visit).alias("seen"))
    media = F.filter("seen", lambda x: ~x["is_text"])
    return seen.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", F.array_join(F.transform("seen", lambda x: x["body"]), ""), F.lit(END)).alias("piece"),
        F.when(F.col("role") == LOSS_ROLE, _spans(F.col("seen"), F.length("head"))).otherwise(F.array().cast(_SPANS)).alias("loss"),
        F.transform(media, lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attachments"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: formatted, turns (length in code points, loss spans and attachments of each, in order) and
    media_tokens, the tokens that all placeholders will be expanded to."""
    one = F.struct("turn", "role", "piece", "loss", "attachments")
    whole = format_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_all"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("_all", lambda x: F.struct(F.length(x["piece"]).alias("length"), x["loss"].alias("loss"), x["attachments"].alias("attachments"))).alias("turns"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + F.aggregate(x["attachments"], F.lit(0).cast("long"), lambda a, y: a + y["tokens"])).alias("media_tokens"),
    )


def _unvisited(body: Column) -> Column:
    """The parts of a body: text, or the kind of a placeholder."""
    marks = "|".join([*MEDIA, OTHER])
    cut = F.split(body, rf"(?=<\|(?:{marks})\|>)|(?<=<\|(?:{marks})\|>)")
    mark = lambda x: F.regexp_extract(x, rf"^<\|({marks})\|>$", 1)
    part = lambda x: F.struct(F.when(mark(x) == "", F.lit("text")).otherwise(mark(x)).alias("kind"), F.when(mark(x) == "", unescaped(x)).alias("text"))
    return F.filter(F.transform(cut, part), lambda p: (p["kind"] != "text") | (p["text"] != ""))


def read_turns(formatted: Column, turns: Column) -> Column:
    """The turns of a formatted conversation: role, parts (kind, text), text (all text parts), loss (all text under the mask)."""
    pieces = F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.size(turns)), lambda x: F.concat(F.lit(TURN), x))

    def one(z):
        head = F.substring_index(z["piece"], TEXT, 1)
        at = F.length(head) + len(TEXT)
        body = F.substring(z["piece"], at + 1, F.length(z["piece"]) - at - len(END))
        parts = _unvisited(body)
        masked = F.transform(z["own"]["loss"], lambda s: unescaped(F.substring(z["piece"], s["start"] + 1, s["length"])))
        return F.struct(
            unescaped(F.substring(head, F.lit(len(TURN) + 1), F.length(head))).alias("role"),
            parts.alias("parts"),
            F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), "").alias("text"),
            F.array_join(masked, "").alias("loss"),
        )

    return F.transform(F.arrays_zip(pieces.alias("piece"), turns.alias("own")), one)


#: The conversation that the contract adds: both of its texts look like a template's control strings.
ADDED = -7, r"\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, write them, and report them as read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(table.dtypes)
    added = [spark.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(table.columns, (ADDED[0], turn, role, ADDED[1]))]) for turn, role in enumerate(("user", LOSS_ROLE))]
    rows = reduce(DataFrame.unionByName, added, table)
    whole = staged(format_conversations(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("content"))), "chat")
    back = whole.select("conv_id", "formatted", read_turns(F.col("formatted"), F.col("turns")).alias("back"))
    text = back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("back", lambda x: x["loss"]), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return text.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
