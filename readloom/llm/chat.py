"""Multi-party perspective rotation: each participant in turn is the assistant.

For every participant of a conversation the dialogue is rendered with that speaker's
turns under the assistant's header and all others as named users; masks are the
character spans of the assistant's words, with the end marker, that a model is trained on.
System turns are context: every perspective shows them, nobody takes their part.

A rendered text of ``TURNS`` turns at most is one row. Longer dialogues come in numbered
parts of as many turns, so that no task holds an unbounded dialogue; every later part
begins with the system turn in force there, the last one before it, so that no part
is without its instructions. That turn is not counted in ``n_turns`` again. Turns are
numbered by a range sort over all tasks, not by a window over the conversation. The rows
asked for are participants x parts: a dialogue with as many speakers as turns grows
with the square of its length by the nature of the operator, spread over its parts.

Order: turn, then speaker, then text; null turns first. A null role speaks as
``unknown``, a null text is empty; rows with a null conversation id are one conversation.
A conversation of system turns only has nobody to be the assistant: it is rendered once,
with a null speaker and an empty mask. Repeated turns stay. ``<|`` in names and texts
becomes ``< |``, so that no text can open a header. Ids keep their type; other columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import stored

TURNS = 256
CONTEXT = ("system",)
END = "<|end|>\n"


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, at (place in the conversation from 0), speaker, text; and conv, turns: both over stored tables."""
    spark = conversations.sparkSession
    safe = lambda c, other: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(other)), F.lit("<|"), F.lit("< |"))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), safe("role", "unknown").alias("speaker"), safe("text", "").alias("text"))
    keys = ["conv", "turn", "speaker", "text", "uid"]  # uid: equal turns may be dealt to several tasks; they are alike, so any order of theirs will do
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    local = stored(local.select("conv", "speaker", "text", F.shiftright("at", 33).cast("int").alias("task"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "turns")
    # One row for each task: small enough to be broadcast, whatever the input.
    offsets = local.groupBy("task").count().withColumn("offset", F.sum("count").over(Window.orderBy("task")) - F.col("count")).select("task", "offset")
    placed = local.join(F.broadcast(offsets), "task").select("conv", "speaker", "text", (F.col("offset") + F.col("place")).alias("row"))
    firsts = stored(placed.groupBy("conv").agg(F.min("row").alias("first"), F.count("*").alias("turns")), "first-turns")
    return _join(placed, firsts, "inner").select("conv", (F.col("row") - F.col("first")).alias("at"), "speaker", "text"), firsts.select("conv", "turns")


def _join(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """On ``conv``, where null equals null, and on ``more``."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in ("conv", *more)})
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    for c in more:
        on &= F.col(c) == F.col(f"_{c}")
    joined = left.join(other, on, how)
    return joined if how == "left_semi" else joined.drop("_conv", *(f"_{c}" for c in more))


def _in_force(placed: DataFrame, turns: int, is_context: Column) -> DataFrame:
    """conv, part, force (speaker, text): the last context turn before each later part."""
    later = placed.where((F.col("at") >= turns) & (F.col("at") % turns == 0)).select("conv", F.expr(f"at div {turns}").alias("part"))
    given = placed.where(is_context).groupBy("conv", F.expr(f"at div {turns}").alias("part")).agg(F.max_by(F.struct("speaker", "text"), "at").alias("said"))
    both = later.withColumn("said", F.lit(None).cast(given.schema["said"].dataType)).withColumn("ask", F.lit(True)).unionByName(given.withColumn("ask", F.lit(False)))
    before = Window.partitionBy("conv").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("force", F.last("said", ignorenulls=True).over(before)).where("ask").select("conv", "part", "force")


def rotate(conversations: DataFrame, turns: int = TURNS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own, rendered, mask (array of start and end in ``rendered``)."""
    placed, lengths = numbered_turns(conversations)
    is_context = F.col("speaker").isin(*context)
    parts = placed.groupBy("conv", F.expr(f"at div {turns}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "text"))).alias("said"))
    several = lengths.where(F.col("turns") > turns)
    if several.isEmpty():
        parts = parts.withColumn("force", F.lit(None).cast("struct<speaker:string,text:string>"))
    else:
        parts = _join(parts, _in_force(_join(placed, several, "left_semi"), turns, is_context), "left", "part")
    people = placed.where(~is_context).select("conv", F.col("speaker").alias("me")).distinct()
    both = _join(parts, people, "left")
    mine = lambda x: F.coalesce(x["speaker"] == F.col("me"), F.lit(False))
    header = lambda x: F.when(mine(x), F.lit("<|assistant|>\n")).when(x["speaker"].isin(*context), F.concat(F.lit("<|"), x["speaker"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), x["speaker"], F.lit("|>\n")))
    again = F.when(F.col("force").isNotNull(), F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.col("force.speaker").alias("speaker"), F.col("force.text").alias("text")))).otherwise(F.slice("said", 1, 0))
    shown = both.withColumn("shown", F.concat(again, "said"))
    pieces = F.transform("shown", lambda x: F.struct(mine(x).alias("own"), header(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body")))
    rotated = shown.withColumn("pieces", pieces).withColumn("sizes", F.transform("pieces", lambda x: (F.length(x["head"]) + F.length(x["body"])).cast("long")))
    # A part has at most ``turns`` + 1 pieces, so summing up to each is bounded.
    spans = F.expr("transform(pieces, (x, i) -> named_struct('own', x.own, 'start', aggregate(slice(sizes, 1, i), 0L, (a, n) -> a + n) + length(x.head), 'end', aggregate(slice(sizes, 1, i + 1), 0L, (a, n) -> a + n)))")
    rotated = rotated.withColumn("spans", F.filter(spans, lambda x: x["own"]))
    return rotated.select(
        F.col("conv").alias("conv_id"),
        F.col("me").alias("speaker"),
        F.col("part").cast("long").alias("part"),
        F.size("said").cast("long").alias("n_turns"),
        F.size("spans").cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask"),
    )
