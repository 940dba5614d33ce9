"""Chat formatting from event logs, with DataFrame functions only.

A log has one row an event: ``conv_id, seq, kind, turn, role, text``. Kinds: ``message`` (a whole message), ``delta`` (a
streamed piece, appended to the turn's message), ``edit`` (replaces the turn's message), ``regenerate`` (drops what the
turn has and all later turns; deltas or a message follow), ``delete`` (drops the turn). Logs are partitioned by
conversation, sorted by sequence and folded: a running count of resets in a turn tells which events its final message is
made of, and a running maximum tells which turns a later regeneration has cut off. Only the surviving pieces are
gathered, once per message and once per conversation.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts the escape sign ``\\``
becomes ``\\e`` and ``<|`` becomes ``\\l`` (in roles a line feed becomes ``\\n`` too), so no text can hold a control string
and the output reads back exactly. The loss mask has an entry for each turn: null, or for an assistant the [start, end) code
point span of its text in the formatted string, with ``base``, where the turn begins.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; events of equal seq are
ordered by turn, kind, role and text, so ties and repeated rows have one result; an empty log gives an empty result;
extra columns are ignored. A conversation becomes one row by contract, so it has to fit in a task; nothing else has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LEARN = "<|im_start|>", "<|im_end|>", "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def rebuild(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages."""
    e = events.select(
        "conv_id", F.col("seq").cast("long"), F.col("turn").cast("long"), F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["seq", "turn", "kind", "role", "text"]
    by_conv = Window.partitionBy("conv_id").orderBy(*order)
    e = e.withColumn("n", F.row_number().over(by_conv))
    # A regeneration of a turn cuts off what came before it at that turn or later ones: the lowest turn regenerated after an event.
    later = Window.partitionBy("conv_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    e = e.where("cut is null or turn is null or turn < cut")
    by_turn = Window.partitionBy("conv_id", "turn")
    last_reset = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate", "delete"), F.col("n"))).over(by_turn)
    e = e.withColumn("reset", last_reset).where("reset is null or n >= reset")
    first = F.min_by("kind", "n")
    return (
        e.groupBy("conv_id", "turn")
        .agg(
            first.alias("first"),
            F.max_by(F.when(F.col("role") != "", F.col("role")), F.when(F.col("role") != "", F.col("n"))).alias("role"),
            F.array_sort(F.collect_list(F.when(F.col("kind").isin("message", "edit", "delta"), F.struct("n", "text")))).alias("parts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .where("first not in ('delete', 'regenerate') or n_events > 1")
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask): a row for each conversation."""
    head = F.concat(F.lit(START), escape_role("role"), F.lit("\n"))
    body = escape("text")
    m = messages.select("conv_id", "turn", head.alias("head"), body.alias("body"), (F.col("role") == LEARN).alias("learn"))
    length = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.sum(length).over(w) - F.length("body") - F.lit(len(END) + 1)
    m = m.withColumn("start", start.cast("long")).withColumn("k", F.row_number().over(w))
    piece = F.struct("k", F.concat("head", "body", F.lit(END + "\n")).alias("s"))
    span = F.struct((F.col("start") - F.length("head")).alias("base"), F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    mask = F.struct("k", F.when(F.col("learn"), span).alias("span"))
    return m.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_join(F.array_sort(F.collect_list(piece)).getField("s"), "").alias("formatted"), F.array_sort(F.collect_list(mask)).getField("span").alias("loss_mask")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """The formatted strings read back: turns as an array of (role, text), and the text under the mask, unescaped."""
    turns = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1_000_000_000)
    turn = F.transform(
        turns,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t) - F.length(F.substring_index(t, "\n", 1)) - F.lit(2 + len(END)))).alias("text"),
        ),
    )
    # a span is read in its own turn, so that a long conversation is not walked from its start for each of them
    offset = lambda s: (s["start"] - s["base"]).cast("int") - F.lit(len(START) - 1)
    spans = F.zip_with(turns, "loss_mask", lambda t, s: unescape(F.substr(t, offset(s), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turn).withColumn("learned", F.array_join(spans, ""))


def as_events(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as the log of how they could have come about, in the order of turn, role and text. Rows that repeat a turn stay apart.

    An assistant's text is streamed to its half, regenerated, and streamed anew in two deltas; any other text is sent by half
    and then edited to the whole. The events of a turn follow all of those before it.
    """
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", turn.alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    first, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1, size - half)

    def events(*own):
        return F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in own))

    streamed = events(("delta", first), ("regenerate", F.lit("")), ("delta", first), ("delta", rest))
    edited = events(("message", first), ("edit", F.col("text")))
    log = rows.select("conv_id", "turn", "role", F.posexplode(F.when(F.col("role") == LEARN, streamed).otherwise(edited)).alias("j", "event"))
    return log.select("conv_id", (F.col("turn") * 4 + F.col("j")).alias("seq"), "event.kind", "turn", "role", "event.text")
